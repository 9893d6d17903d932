"""Many literal terms against many texts in one pass: an Aho-Corasick automaton.

``Terms`` compiles a table of terms into automata once; ``hits`` sends texts through them
where they are: one Arrow projection, no shuffle, no index of the texts.  The work for a
text grows with its length and its hits, not with the number of terms, so a stream of new
postings is matched against all subscriptions at the cost of reading it.

Terms come to the driver shard by shard, each of a bounded number of characters, and are
broadcast; a table of more terms than one shard holds is several passes over the texts
(a stated table against all rows, in blocks).
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_CHARS = 1 << 20
_KEPT = 4  # automata that a Python worker keeps
_BUILT: OrderedDict[str, tuple] = OrderedDict()


def build(terms: list[str]):
    """(automaton or None, whether the empty term, which every text holds, is there)."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for t in terms:
        if t:
            found.add_word(t, t)
    if len(found):
        found.make_automaton()
    return (found if len(found) else None), "" in terms


def _automaton(name: str, shared):
    """The automaton of a broadcast shard, built once in each Python worker."""
    if name not in _BUILT:
        _BUILT[name] = build(shared.value)
        while len(_BUILT) > _KEPT:
            _BUILT.popitem(last=False)
    _BUILT.move_to_end(name)
    return _BUILT[name]


class Terms:
    """Compiled distinct terms of ``terms(col)``; null terms match nothing."""

    def __init__(self, terms: DataFrame, col: str = "term", shard_chars: int = SHARD_CHARS) -> None:
        from ..session import materialize
        spark = terms.sparkSession
        distinct = materialize(terms.select(F.col(col).alias("term")).where("term is not null").distinct(), "terms")
        size, n = distinct.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0)), F.count(F.lit(1))).first()
        shards = max(1, -(-size // shard_chars))
        # bounded: about shard_chars characters at a time
        parts = (distinct.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == i) for i in range(shards)) if n else ()
        self.shards = [(uuid.uuid4().hex, spark.sparkContext.broadcast([r.term for r in p.collect()])) for p in parts]

    def hits(self, texts: DataFrame, tid: str = "tid", text: str = "text", term: str = "term") -> DataFrame:
        """(``term``, ``tid``): each distinct term that a text contains, as written; a text may be
        an array of texts, whose terms count once.  A null text holds no term."""
        read = texts.select(F.col(tid).alias("tid"), F.col(text).alias("text")).where("text is not null")
        out = T.StructType().add(term, "string").add(tid, read.schema["tid"].dataType)

        def one(shard) -> DataFrame:
            name, shared = shard

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found, everywhere = _automaton(name, shared)
                always = [""] if everywhere else []
                for b in batches:
                    rows, terms = [], []
                    for i, t in enumerate(b["text"].to_pylist()):
                        each = [t] if isinstance(t, str) else [x for x in t if x is not None]
                        some = always if each else []
                        held = {w for x in each for _, w in found.iter(x)}.union(some) if found else some
                        terms.extend(held)
                        rows.extend([i] * len(held))
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b["tid"].take(pa.array(rows, pa.int64()))], out.names)

            return read.mapInArrow(run, out)

        if not self.shards:
            return texts.sparkSession.createDataFrame([], out)
        return reduce(DataFrame.unionByName, map(one, self.shards))
