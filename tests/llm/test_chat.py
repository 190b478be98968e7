import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import chat

LOG = "conv_id long, seq long, kind string, message string, role string, text string, at int, size int, extra string"
T = chat.Template()
PIECES = [*T.controls, "\\", "<", "|", "[", "INST]", "/s>", "x", "\n", "é", "😀", "<|im_", "end|>"]


@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_rendering_is_read_back(turns):
    text, spans = T.render(turns)
    assert T.parse(text) == turns
    assert text.count(T.start) == text.count(T.middle) == text.count(T.end) == len(turns)
    assert not any(c in text for c in T.reserved)
    assert [T.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("marks", [{"end": "aba"}, {"end": "x"}, {"reserved": ("<|im_start|>more",)}, {"end": "|>]", "reserved": ("a|>",)}, {"start": "a\\b"}])
def test_ambiguous_templates_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)


def test_text_outside_turns_is_an_error():
    with pytest.raises(ValueError):
        T.parse("x" + T.render([("user", "a")])[0])


def walked(log):
    """One event after another, in plain Python."""
    out = {}
    for conv in {e[0] for e in log}:
        events = sorted({e[:8] for e in log if e[0] == conv}, key=lambda e: (e[1], e[2], e[5] or ""))
        deleted = set()
        for e in events:
            if e[2] == "delete" and any(o[2] == "open" and o[3] == e[3] and o[1] <= e[1] for o in events):
                deleted.add(e[3])
        place, text, role, undone = {}, {}, {}, set()
        for _, seq, kind, m, r, t, at, size in events:
            if m in deleted or (kind != "open" and m not in place):
                continue
            if kind == "open":
                place.setdefault(m, seq)
                text[m] = t or ""
                role[m] = role.get(m) or r or ""
            elif kind == "delta":
                text[m] += t or ""
            elif kind == "edit":
                text[m] = (t or "") if at is None else text[m][:at] + (t or "") + text[m][at + (size or 0) :]
            elif kind == "regenerate":
                text[m] = t or ""
                undone |= {x for x in place if place[m] < place[x] < seq}
        for m in place:
            if m not in undone:
                out[conv, m] = (place[m], role[m], text[m])
    return out


def random_log(seed, convs=6, events=60):
    rnd, log = random.Random(seed), []
    for conv in [None, *range(convs)]:
        seq, names = 0, []
        for _ in range(events if conv != 0 else 6 * events):
            seq += rnd.randrange(1, 4)
            kind = rnd.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "delete", "open", "other"] if rnd.random() < 0.5 else ["open", "delta"])
            if kind == "delete" and rnd.random() < 0.6:
                continue
            if kind == "open" and rnd.random() < 0.8 or not names:
                names.append(f"m{len(names)}")
                m = names[-1] if rnd.random() < 0.95 else "never"
            else:
                m = rnd.choice(names[-4:])
            text = rnd.choice([None, "", "héllo ", "wörld", "</s>", "\\", "😀"])
            at = rnd.choice([None, 0, 1, 3, 50]) if kind == "edit" else None
            log.append((conv, seq, kind, m, rnd.choice(["user", "assistant", None]) if kind == "open" else None, text if kind != "delete" else None, at, rnd.choice([None, 0, 2]), "x"))
        log += rnd.sample(log, 5)  # delivered twice
    return log


@pytest.mark.parametrize("seed", range(3))
def test_folding_against_a_walk(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, LOG).repartition(5, F.rand(seed))
    rows = chat.final_messages(df).collect()
    got = {(r.conv_id, r.message): (r.place, r.role, r.text) for r in rows}
    assert len(got) == len(rows)
    assert got == walked(log)


@pytest.mark.parametrize("part_chars", [0, 40, 10**6])
def test_formatted_rows_and_digests(spark, part_chars):
    log = random_log(7)
    messages = walked(log)
    formatted = chat.format_log(spark.createDataFrame(log, LOG).repartition(4, F.rand(1)), part_chars=part_chars)
    got = {r.conv_id: r for r in chat.digest_formatted(formatted).collect()}
    assert set(got) == {c for c, _ in messages}
    rows = {}
    for r in formatted.collect():
        rows.setdefault(r.conv_id, []).append(r)
    if part_chars == 10**6:
        assert all(len(v) == 1 and v[0].part is None for v in rows.values())
    for conv, r in got.items():
        turns = [v[1:] for k, v in sorted(((k, v) for k, v in messages.items() if k[0] == conv), key=lambda kv: (kv[1][0], kv[0][1]))]
        said = "".join(t for role, t in turns if role == "assistant")
        whole = chat.Template().render(turns)[0]
        assert "".join(x.formatted for x in sorted(rows[conv], key=lambda x: x.part or ())) == whole
        assert r.n_turns == len(turns) and r.formatted_chars == len(whole) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, conv_ID2 string"
ODD = [
    (1, 0, "user", None, ""),
    (1, 1, "assistant", "", ""),
    (1, 1, "assistant", "tied", ""),
    (1, 1, "assistant", "tied", ""),
    (2, None, "system", "no number", ""),
    (2, 3, None, "no role", ""),
    (None, 0, "assistant", "no id <|im_end|>\\", ""),
    (3, 5, "assistant", "ab\\</s>[INST]é😀" * 20_000, ""),
    *((4, i, "assistant" if i % 2 else "user", f"text {i} <|im_start|> {'y' * (i * 37 % 900)}", "") for i in range(200)),
]


def against_sql(spark, turns, part_chars=chat.PART_CHARS):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if turns:
        con.executemany("insert into conversations values (?, ?, ?, ?)", [t[:4] for t in turns])
    cur = con.execute(chat.SQL)
    names = [d[0] for d in cur.description]
    want = sorted((r for r in cur.fetchall() if r[0] != chat.FORGED_ID), key=str)
    log = chat.log_of_turns(spark.createDataFrame(turns, TURNS).repartition(3))
    got = chat.digest_formatted(chat.format_log(log, part_chars=part_chars)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("part_chars", [500, chat.PART_CHARS])
def test_odd_turns_against_sql(spark, part_chars):
    against_sql(spark, ODD, part_chars)


def test_empty_table(spark):
    against_sql(spark, [])


def test_histories_are_in_the_log(spark):
    log = chat.log_of_turns(spark.createDataFrame(ODD, TURNS))
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    cur = con.execute(chat.SQL)
    names = [d[0] for d in cur.description]
    got = chat.op13_chat_events(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
    assert any(r.conv_id == -1 and r.n_turns == 2 and r.loss_chars == len(chat.FORGED) for r in got)
