"""Record operators: upsert, replay, precedence, diff, reconciliation, expectations, linkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_once(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: a later delivery of the same key changes nothing."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}") for c in rest])


def replay(df: DataFrame, key: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """Last state by key and the number of events: a partial maximum, no sort."""
    last = F.max_by(F.col(state), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("state"), F.count(F.lit(1)).alias("version"))


def illegal_transitions(df: DataFrame, key: Sequence[str], state: str, order: Sequence[str], edges: dict[str, set]) -> DataFrame:
    """Adds the state before and whether the step is on the list of edges; first states are legal."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    legal = F.lit(False)
    for a, to in edges.items():
        legal = legal | ((F.col("before") == a) & F.col(state).isin(*sorted(to)))
    return df.withColumn("before", before).withColumn("legal", F.col("before").isNull() | legal)


def precedence(df: DataFrame, subject: str, order: Sequence[str], current: Column, carry: Sequence[str]) -> DataFrame:
    """Each subject's current fact: the greatest by the order among those that count."""
    best = F.max(F.when(current, F.struct(*order, *[c for c in carry if c not in order])))
    out = df.groupBy(subject).agg(best.alias("_b"), F.count(F.lit(1)).alias("facts"))
    return out.select(subject, *[F.col(f"_b.{c}") for c in carry], "facts")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """same, changed, removed or new for each key."""
    o = old.select(*key, F.struct(*values).alias("_o"))
    n = new.select(*key, F.struct(*values).alias("_n"))
    status = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed")
        .when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    )
    return o.join(n, list(key), "full_outer").select(*key, status.alias("status"))


def reconcile(validated: DataFrame, reading: DataFrame, key: Sequence[str], value: str, max_edit: int = 2) -> DataFrame:
    """kept (equal), repaired (validated value within max_edit), conflict, or new."""
    v = validated.select(*key, F.col(value).alias("validated"))
    r = reading.select(*key, F.col(value).alias("reading"))
    near = F.levenshtein("validated", "reading", max_edit)
    verdict = (
        F.when(F.col("validated").isNull(), "new").when(F.col("validated") == F.col("reading"), "kept")
        .when(near >= 0, "repaired").otherwise("conflict")
    )
    value_ = F.when(verdict.isin("kept", "repaired"), F.col("validated")).otherwise(F.col("reading"))
    return r.join(v, list(key), "left").select(*key, verdict.alias("verdict"), value_.alias("value"))


def expectations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, row_key for each row that breaks a rule: one pass, rules as an array."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), key.alias("row_key"))


def manifest_diff(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status of every path in either table of path, bytes, sha256: same, changed, resized, missing, extra or repeated.

    Missing paths are in the manifest alone, extra ones are found alone; a path that either table has twice is repeated,
    whatever it holds. Digests compare without case, and a null size or digest differs from any other. Null paths are one path.
    """
    sides = found.select("path", "bytes", "sha256", F.lit(1).alias("f")).unionByName(manifest.select("path", "bytes", "sha256", F.lit(0).alias("f")))
    n, low = F.count(F.lit(1)), F.lower("sha256")
    both = sides.groupBy("path").agg(
        F.sum("f").alias("found"), (n - F.sum("f")).alias("listed"),
        (F.min("bytes").eqNullSafe(F.max("bytes")) & (F.count("bytes") == n)).alias("size"), ((F.min(low) == F.max(low)) & (F.count(low) == n)).alias("digest"),
    )
    status = (
        F.when((F.col("found") > 1) | (F.col("listed") > 1), "repeated").when(F.col("found") == 0, "missing").when(F.col("listed") == 0, "extra")
        .when(~F.col("size"), "resized").when(F.coalesce(F.col("digest"), F.lit(False)), "same").otherwise("changed")
    )
    return both.select("path", status.alias("status"))


def is_current(found: DataFrame, manifest: DataFrame) -> bool:
    """Whether derived data is fresh: what is found is what the manifest lists, no more and no less."""
    return manifest_diff(found, manifest).where("status <> 'same'").isEmpty()


def leak_guard(fields: DataFrame, kinds: Column) -> tuple[DataFrame, DataFrame]:
    """Fields without the values that may not be kept, and the incidents: id, key, kinds, never a value.

    fields: id, key, value, status; `kinds` as `functions.text.pii_incident` gives them. A value in an identifier's field is
    NOT_PROVIDED from then on, another one has to be asked again (REVIEW); repeated rows are repeated incidents.
    """
    marked = fields.withColumn("_kinds", kinds)
    hit, own = F.size("_kinds") > 0, F.array_contains("_kinds", "identifier_field")
    status = F.when(hit & own, "NOT_PROVIDED").when(hit, "REVIEW").otherwise(F.col("status"))
    kept = marked.withColumns({"status": status, "value": F.when(~hit, F.col("value")), "redacted": hit}).drop("_kinds")
    return kept, marked.where(hit).select("id", "key", F.concat_ws(",", "_kinds").alias("kinds"))
