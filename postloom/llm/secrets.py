"""Credential spans, told apart by how widely their values are owned.

A scan of every text gives spans of the base kinds and some more. Then the whole
corpus votes on each value: its hash is counted over distinct repositories
(texts) and distinct owners (sources). A value that many owners publish is a copied
example; one that a single owner holds is live; the rest is shared. Whether a
value looks like a placeholder is told beside that and decides nothing.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.store import stored

#: Owners and texts from which a value counts as a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_TEXTS = 8
#: Bits a character; less looks typed, not drawn.
PLACEHOLDER_BITS = 2.2
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]?|xxxx|dummy|sample|1234567", re.I | re.A)

# Kind, pattern, group of the value, least characters of that group, strings of which a text with a match holds one.
# The first three are fixed by contract, in this order.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("akia",)),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32, ()),
    # Any body up to the closing line; without one, lines as they stand in keys. The value is the body: the first line is the same in all keys.
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:((?:(?!-----BEGIN |-----END )[\s\S])+)-----END [A-Z ]*PRIVATE KEY-----|((?:\s*(?:[A-Za-z0-9+/=]{16,}|[A-Z][A-Za-z-]*: [^\n]*))+))"), (1, 2), 1, ("-----begin ",)),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 1, ("eyj",)),
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("login", re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]+:([^\s/@]+)@"), 1, 1, ("://",)),
)
BASE = 3
#: Rows looked at together.
_ROWS = 1000


def find(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in code points, by start and then kind.

    Matches of a kind are leftmost and do not overlap; those with a short value are dropped afterwards.
    """
    low, found = text.lower(), []
    for order, (kind, pattern, group, least, hints) in enumerate(KINDS):
        if hints and not any(h in low for h in hints):
            continue
        for m in pattern.finditer(text):
            of = group if isinstance(group, int) else next(g for g in group if m[g] is not None)
            if m.end(of) - m.start(of) >= least:
                found.append((m.start(), order, kind, m.end(), m.start(of), m.end(of)))
    return [(kind, start, end, a, b) for start, _, kind, end, a, b in sorted(found)]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


_SPAN = "kind string, start bigint, end bigint, value_start bigint, value_end bigint, value bigint, placeholder boolean"


def _scan(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Spans of every row under a row number of its own; ``whole`` brings the row along as ``row``."""
    span = pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("start", "end", "value_start", "value_end", "value")), ("placeholder", pa.bool_())])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield batch.slice(at, _ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, counts, digests, lists = [], [], [], []
            texts = batch.column(3).field(place) if whole else batch.column(3)
            for text in texts:
                text = text.as_py() or ""
                own = find(text)
                spans.append([
                    {"kind": k, "start": s, "end": e, "value_start": a, "value_end": b,
                     "value": int.from_bytes(blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True),
                     "placeholder": bool(_PLACEHOLDER.search(text, a, b)) or (k != "pem" and entropy(text[a:b]) < PLACEHOLDER_BITS)}
                    for k, s, e, a, b in own
                ])
                n = Counter(k for k, *_ in own)
                counts.append([n[KINDS[i][0]] for i in range(BASE)])
                base = {KINDS[i][0] for i in range(BASE)}
                digests.append(sha256(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in own if k in base).encode()).hexdigest())
                lists.append(",".join(f"{k}:{s}:{e}" for k, s, e, *_ in own))
            kinds = [pa.array([c[i] for c in counts], pa.int64()) for i in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *kinds, pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(spans, pa.list_(span)), *batch.columns[3 : 3 + whole]],
                ["doc_id", "t", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", *["row"] * whole],
            )
        pa.default_memory_pool().release_unused()

    place = docs.columns.index("text")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("source").cast("string").alias("owner"), F.struct("*").alias("row") if whole else F.col("text"))
    schema = f"doc_id bigint, t bigint, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<{_SPAN.replace(' ', ':').replace(',:', ', ')}>>" + (f", row {read.schema['row'].dataType.simpleString()}" if whole else "")
    return read.mapInArrow(rows, schema).withColumn("rid", F.monotonically_increasing_id())


def _judged(scanned: DataFrame) -> DataFrame:
    """(rid, judged): the spans of each row that has some, with verdicts."""
    each = scanned.where(F.size("found") > 0).select("rid", "t", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.posexplode("found").alias("at", "s"))
    each = each.select("rid", "t", "owner", "at", "s.*")
    owned = each.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("t").alias("texts"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("texts") >= EXAMPLE_TEXTS)
    verdict = F.when(example, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    judged = each.join(owned, "value").withColumn("verdict", verdict)
    # One document's spans come together, no others.
    parts = F.array_sort(F.collect_list(F.struct("at", "kind", "start", "end", "value_start", "value_end", "placeholder", "verdict")))
    return judged.groupBy("rid").agg(parts.alias("judged"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_assign, n_access, n_hex, base_sha256, spans, verdicts, n_live, n_shared, n_example, n_placeholder, found), one row per row of ``docs``.

    docs: doc_id bigint, text string, source string; other columns are not read.
    spans lists kind:start:end of all spans, verdicts one of live, shared and
    example for each of them, both comma-joined in the same order; found holds
    the spans with the places of their values and their verdicts; n_placeholder counts
    values that look typed. t is xxhash64(text). Null and empty texts have no spans (and
    the SHA-256 of no bytes). A null source is one owner. Equal texts are one
    repository, so repeated rows change no verdict; a null doc_id is a document like
    others. No rows give no rows.
    """
    scanned = stored(_scan(docs), "secret-spans")
    count = lambda name, test: F.coalesce(F.size(F.filter("judged", test)), F.lit(0)).cast("bigint").alias(name)
    is_ = lambda v: lambda s: s["verdict"] == v
    counts = [count(f"n_{v}", is_(v)) for v in ("live", "shared", "example")] + [count("n_placeholder", lambda s: s["placeholder"])]
    met = scanned.drop("found").join(_judged(scanned), "rid", "left").withColumn("judged", F.coalesce("judged", F.expr("filter(array(named_struct('at', 0, 'kind', '', 'start', 0L, 'end', 0L, 'value_start', 0L, 'value_end', 0L, 'placeholder', false, 'verdict', '')), x -> false)")))
    return met.select(
        "doc_id", "t", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        F.array_join(F.transform("judged", lambda s: s["verdict"]), ",").alias("verdicts"), *counts, F.col("judged").alias("found"),
    )


def _masked(text: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(x, spans):
        if x is None or spans is None or not len(spans):
            return x
        out, at = [], 0
        for start, end in sorted((s["value_start"], s["value_end"]) for s in spans):
            if end <= at:
                continue
            if start >= at:
                out += [x[at:start], "[SECRET]"]
            at = end
        return "".join(out) + x[at:]

    return pd.Series([one(x, s) for x, s in zip(text, cuts, strict=True)], dtype=object)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the values of live and shared credentials replaced by [SECRET]; same rows, same columns.

    Copied examples stay, and so do null and empty texts. Repeated rows, null ids and
    columns of any name are kept as they are; n_chars, if there, counts the new text where it changed. Of
    overlapping values the earlier is masked, with what the later one adds. Only rows
    with spans move to meet their verdicts.
    """
    scanned = stored(_scan(docs, whole=True), "secret-rows")
    cuts = _judged(scanned).select("rid", F.filter("judged", lambda s: s["verdict"] != "example").alias("cuts"))
    clean = scanned.where("size(found) = 0").select("row.*")
    dirty = scanned.where("size(found) > 0").select("rid", "row").join(cuts, "rid").select("row", "cuts")
    dirty = dirty.withColumn("masked", F.pandas_udf(_masked, "string")("row.text", "cuts"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("cuts") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.union(dirty.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
