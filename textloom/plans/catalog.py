"""Every query of the engine by name, with its SQL counterpart."""

from textloom.plans import chat, corpus, ingest, leakage, ledger, ngrams, payloads, records, rows, studies, tokenizer  # noqa: F401
from textloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
