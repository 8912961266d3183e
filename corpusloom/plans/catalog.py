"""All named queries."""

from corpusloom.plans import q_answers, q_chunks, q_curation, q_flows, q_landed, q_retrieval  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL  # noqa: F401
