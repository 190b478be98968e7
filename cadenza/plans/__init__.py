"""Registered queries.  Importing this package fills the catalogue."""

from cadenza.plans import alignment_queries as _alignment  # noqa: F401
from cadenza.plans import assembly_queries as _assembly  # noqa: F401
from cadenza.plans import boundary_queries as _boundaries  # noqa: F401
from cadenza.plans import curation_queries as _curation  # noqa: F401
from cadenza.plans import decision_queries as _decisions  # noqa: F401
from cadenza.plans import delivery_queries as _deliveries  # noqa: F401
from cadenza.plans import discovery_queries as _discovery  # noqa: F401
from cadenza.plans import evidence_queries as _evidence  # noqa: F401
from cadenza.plans import fold_queries as _folds  # noqa: F401
from cadenza.plans import interval_queries as _intervals  # noqa: F401
from cadenza.plans import mechanism_queries as _mechanisms  # noqa: F401
from cadenza.plans import more_queries as _more  # noqa: F401
from cadenza.plans import policy_queries as _policy  # noqa: F401
from cadenza.plans import rescue_queries as _rescues  # noqa: F401
from cadenza.plans import text_queries as _texts  # noqa: F401
from cadenza.plans import tier_queries as _tiers  # noqa: F401
from cadenza.plans import vector_queries as _vectors  # noqa: F401
