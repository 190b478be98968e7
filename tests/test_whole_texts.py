"""Queries that take whole texts, by brute force on small tables."""

import re

import pytest

from cadenza.plans.catalogue import queries

LONG = "word " * 100
TEXTS = [
    LONG + "<b>bold</b> end", LONG + "\n♪ la la", "- one speaker", "- one\n- other", "- one\nmiddle\n- other", LONG + "\n- one\n- other",
    "Anna: hello\n" + LONG + "\nBob: {x}bye", "(aside) text\n" + LONG, "plain", "", None,
]


def brute_clean(text):
    if text is None:
        return None
    plain = re.sub(r"\{[^}]*\}|<[^>]*>", "", text)
    lines = plain.split("\n")
    if re.search("[♪♫♬]", plain) or sum(bool(re.match(r"\s*[-–—]\s*\S", x)) for x in lines) > 1:
        return ""
    bare = [re.sub(r"^\s*(\([^)]*\)|\[[^\]]*\]|[A-Z][\w .]{0,20}:)\s*", "", re.sub(r"^\s*[-–—]\s*", "", x)) for x in lines]
    return " ".join(" ".join(bare).split())


def test_dialogue_is_cleaned_whole_and_no_row_is_lost(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.line for r in queries()["X7_clean_dialogue_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_clean(t) for i, t in enumerate(TEXTS)}


def brute_lcs(a, b):
    a, b = ([c for c in x.lower() if c.isalpha()] for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_turns_are_named_joined_and_compared_whole(spark, tmp_path):
    texts = ["!" * 70 + "name", LONG + "first", "x" * 250 + "abc", "y" * 250 + "abd", "z" * 100]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {r.turn: r[2] for r in queries()[name](spark, str(tmp_path)).collect()}
    assert run("X1_safe_name_whole") == {i: re.sub(r"[^\w.-]+", "_", t).strip("_.")[:80] for i, t in enumerate(texts)}
    assert run("X6_join_texts_whole") == {i: " ".join(t.strip() for t in texts[i : i + 2]) for i in range(5)}
    assert run("X9_text_similarity") == {i: pytest.approx(brute_lcs(*texts[i : i + 2]), abs=1e-6) for i in range(4)}


def said(text):
    """The rule by itself, over plain strings."""
    import re

    kana = lambda x: re.search("[\\u3040-\\u30ff]", x)
    t = re.sub(r"<[^>]+>|\{[^}]*\}", "", text or "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"), ("\\N", "\n"), ("\\n", "\n"), ("\\h", " ")):
        t = t.replace(a, b)
    lines = [x.strip() for x in t.splitlines() if x.strip()]
    names = {m for m in re.findall(r"^(?:[-–—][^\S\n]*)?([^:：\n]{1,24})[:：]", t, re.M)}
    labels = {m[1] for x in lines if (m := re.match(r"[（(【\[]([^）)】\]]{1,24})[）)】\]]\s*\S", x))}
    if re.search("[♪♫♬]", t) or sum(bool(re.match(r"[-–—]\s*\S", x)) for x in lines) > 1 or len(names) > 1 or len(labels) > 1:
        return ""
    if any(map(kana, lines)) and any(not kana(x) and re.search("[\\u4e00-\\u9fff]", x) for x in lines):
        lines = [x for x in lines if kana(x)]
    for p in (r"^[-–—]\s*", r"^[^:：]{1,24}[:：]\s*", r"^[（(【\[][^）)】\]]{1,24}[）)】\]]\s*"):
        lines = [re.sub(p, "", x) for x in lines]
    lines = [x.strip() for x in lines if x.strip()]
    line = re.sub(r"\s+", " ", ("" if any(map(kana, lines)) else " ").join(lines)).strip()
    return line if re.search(r"[^\W\d_]", line) else ""


def test_spoken_lines(spark, sf_dir):
    from pyspark.sql import functions as F

    from pyspark.sql import functions as F

    from cadenza.functions import text as tf
    from cadenza.plans.catalogue import queries

    texts = [
        None, "", "hi", "<i>hi</i> {\\an8}you\\Nthere", "- a\n- b", "– one line", "A: x\nB: y", "A: x\nA: y", "A: x", "(noise) go", "(x) a\n[y] b", "【x】 a", "(only)", "♪ la", "こんにちは\n你好", "こん\nにちは", "你好\n世界",
        "a &amp; b &lt;", "12 34", "12:30 is late", "\\h x \\h", "a　b", "x\r\ny", "Mr. A: yes\nno", "你好：好", "_ _", "é",
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tf.spoken_line(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [said(t) for t in texts]
    rows = {(r.what, r.id, r.turn): r.line for r in queries()["X7_spoken_lines"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert rows["document", r.doc_id, 0] == said(r.text)
    assert any(rows.values())


def test_cuts_of_a_long_text(spark):
    """Twenty thousand fragments of one text: a pass over it, not one for each fragment."""
    from pyspark.sql import functions as F

    from cadenza.functions import text as tf

    parts = [f"s{i} ü." for i in range(20_000)]
    text = "\n".join(parts)
    df = spark.createDataFrame([(text, parts), (text, parts * 2), (text, None), (None, parts)], "t string, f array<string>")
    got = [r.got for r in df.select(tf.text_cuts(F.col("t"), F.col("f")).alias("got")).collect()]
    want, at = [0], 0
    for p in parts[:-1]:
        at += len(p) + 1
        want.append(at)
    assert got == [[*want, len(text)], None, None, None]
