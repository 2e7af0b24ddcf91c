"""Token counts by prefix dynamic programming (see ``bpe``).

Defined results: a null or empty text has 0 tokens and 0 bytes; special strings
inside texts count as the library takes them (one token); a null doc_id stays null;
equal rows get equal rows; an empty table gives an empty table; extra columns are
ignored; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .bpe import prefix_counter
from .common import arrow_schema

LIMIT = 512


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, budgets: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; with ``budgets`` also ``cut_<budget>``:
    the longest prefix, in characters, that stays within so many tokens."""
    import pyarrow as pa

    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + "".join(f", cut_{b} long" for b in budgets)

    schema = arrow_schema(ddl)

    def count(batches):
        counter = prefix_counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                columns = [part.column(0).to_pylist(), part.column(2).to_pylist()]
                if budgets:
                    found = [counter.prefix(t) for t in texts]
                    n = [p.total for p in found]
                    cuts = [[p.truncate(b) for p in found] for b in budgets]
                else:
                    n, cuts = [counter.count(t) for t in texts], []
                columns += [n, [x > limit for x in n], *cuts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).mapInArrow(count, ddl)
