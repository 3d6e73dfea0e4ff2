"""Secret scans, with parts of credentials linked within scopes.

Strong findings are reported as they are. Weak ones (a bare random-looking token,
an endpoint) are reported only if complementary parts stand in their scope: an
interval join, within `scope` characters of one text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# The patterns of strong findings.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Maximal runs of [0-9a-f]+; those too short are left out by the pattern.
LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")
# The patterns of weak findings: a secret's body (a whole run of 32 to 88 characters), and an endpoint.
BODY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,86}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/._~%?&=+-]*")
#: Kinds in their order within spans; the first three are the base.
KINDS = ("assign", "access", "hex", "body", "endpoint")
SPAN = "struct<kind:int,start:int,end:int>"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in map(s.count, set(s)))


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """Strong and weak findings of a text: kind, start, end in code points."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(2, *m.span()) for m in LONG_HEX.finditer(text)]
    found += [(3, *m.span()) for m in BODY.finditer(text) if varied(m[0])]
    if "://" in text:
        found += [(4, *m.span()) for m in ENDPOINT.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def varied(s: str) -> bool:
    """Whether a token looks random: all three kinds of characters and high entropy."""
    return any(map(str.isdigit, s)) and any(map(str.isupper, s)) and any(map(str.islower, s)) and entropy(s) > 3.5


def finder():
    """A pandas UDF from texts to their parts."""

    @F.pandas_udf(f"array<{SPAN}>")
    def find_parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in parts_of(x)] if x else [] for x in t], dtype=object)

    return find_parts


def weak_with_company(parts: DataFrame, scope: int) -> DataFrame:
    """Of parts (key, kind, start, end), the weak ones that complementary parts stand near.

    A body needs an access identifier or an endpoint in its scope; an endpoint
    needs an access identifier, an assignment or a body. Scopes are joined by bucket of
    position and its neighbours, as a semi-join: no pairs come out.
    """
    at = F.floor(F.col("start") / scope)
    weak = parts.filter("kind >= 3").select("key", "kind", "start", "end", F.explode(F.array(at - 1, at, at + 1)).alias("bucket"))
    other = parts.select(F.col("key").alias("key_"), F.col("kind").alias("kind_"), F.col("start").alias("start_"), F.floor(F.col("start") / scope).alias("bucket_")).filter("kind_ <> 2")
    fits = ((F.col("kind") == 3) & F.col("kind_").isin(1, 4)) | ((F.col("kind") == 4) & F.col("kind_").isin(0, 1, 3))
    near = (F.col("key") == F.col("key_")) & (F.col("bucket") == F.col("bucket_")) & (F.abs(F.col("start") - F.col("start_")) <= scope)
    return weak.join(other, near & fits, "left_semi").select("key", "kind", "start", "end").distinct()


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 300) -> DataFrame:
    """Every row of docs: doc_id and spans, an array of kind (index in KINDS), start, end.

    Positions are code points, the end exclusive; spans are ordered by start,
    then kind. Null and empty texts have none. Rows that repeat an id and text
    have the same spans each. An empty table gives no rows.
    """
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("t_"))
    found = rows.select("doc_id", F.struct("doc_id", F.xxhash64("t_").alias("h"), F.length("t_").alias("n")).alias("key"), finder()("t_").alias("parts"))
    found = staged(found, "parts")
    parts = found.filter(F.exists("parts", lambda x: x["kind"] >= 3)).dropDuplicates(["key"]).select("key", F.inline("parts"))
    weak = weak_with_company(parts, scope).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    out = found.join(weak.withColumnRenamed("key", "k_"), F.col("key").eqNullSafe(F.col("k_")), "left")
    strong = F.filter("parts", lambda x: x["kind"] < 3)
    spans = F.concat(strong, F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return out.select("doc_id", F.transform(ordered, lambda x: F.struct(x["kind"], x["start"], x["end"])).alias("spans"))


def listed(spans) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
