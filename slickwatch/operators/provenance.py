"""Content hashes, manifests, wording guards, lineage and case documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions.text import content_hash

# Wording that must never appear in a published case.
FORBIDDEN_TERMS = (
    "culprit",
    "guilty",
    "proven source",
    "ai confidence",
    "probability of guilt",
    "100% accurate",
)
# Manifest list each evidence type is filed under.
MANIFEST_LISTS = {
    "sar_image": "satellite_imagery",
    "oil_mask": "oil_masks",
    "ais": "ais_data",
    "met_ocean": "met_ocean_data",
    "research_note": "research_notes",
}
# Names and suffixes of raw position files.
POSITION_FILE_WORDS = ("ais_points", "vessel_tracks", "raw_ais", "ais_archive", "ais_raw")
POSITION_FILE_TYPES = ("csv", "parquet", "json", "geojson", "db")


def hash_manifest(expected: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Hash of each expected artefact, FILE_NOT_FOUND when it is absent."""
    hashed = artefacts.select("name", content_hash("content").alias("sha256"))
    return expected.join(hashed, "name", "left").withColumn(
        "sha256", F.coalesce("sha256", F.lit("FILE_NOT_FOUND"))
    )


def freeze_verify(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Current manifest against the frozen one, by name."""
    j = frozen.select("name", F.col("sha256").alias("_f")).join(
        current.select("name", F.col("sha256").alias("_c")), "name", "full_outer"
    )
    state = (
        F.when(F.col("_f").isNull(), "NEW")
        .when(F.col("_c").isNull(), "MISSING")
        .when(F.col("_f") == F.col("_c"), "SAME")
        .otherwise("CHANGED")
    )
    return j.select("name", state.alias("freeze_status"))


def _hits(text: Column, term: str) -> Column:
    """How often ``term`` occurs, by the length its removal takes away."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def forbidden_scan(docs: DataFrame, terms=FORBIDDEN_TERMS, patterns=(), text: str = "text") -> DataFrame:
    """Hits per document: terms in the lower-cased text, patterns in the
    lower-cased text without spaces. Whole texts are scanned."""
    low = F.lower(text)
    tight = F.replace(low, F.lit(" "), F.lit(""))
    counts = [_hits(low, t) for t in terms] + [_hits(tight, p) for p in patterns]
    found = F.array_compact(F.array(*[F.when(F.col("_n")[i] > 0, x) for i, x in enumerate([*terms, *patterns])]))
    return (
        docs.withColumn("_n", F.array(*counts))
        .withColumn("hits", F.aggregate("_n", F.lit(0), lambda a, b: a + b))
        .withColumn("violations", found)
        .withColumn("audit", F.when(F.col("hits") > 0, "FAIL").otherwise("PASS"))
        .drop("_n")
    )


def lineage(files: DataFrame, products: tuple[str, str], by: list[str]) -> DataFrame:
    """The one product named by the files of a group, else AMBIGUOUS."""
    a, b = products
    df = files.groupBy(*by).agg(
        F.bool_or(F.col("file_name").contains(a)).alias("_a"), F.bool_or(F.col("file_name").contains(b)).alias("_b")
    )
    only_a, only_b = F.col("_a") & ~F.col("_b"), F.col("_b") & ~F.col("_a")
    return df.select(
        *by,
        F.when(only_a, a).when(only_b, b).otherwise("AMBIGUOUS").alias("product"),
        F.when(only_a | only_b, "PASS").otherwise("BLOCKED_PROVENANCE").alias("lineage_status"),
    )


def data_mode(ready, available) -> tuple[Column, Column]:
    """Mode and validity; historical only when both flags are YES."""
    ok = (ready == "YES") & (available == "YES")
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, "REAL_HISTORICAL").otherwise("SYNTHETIC_DEMO"), ok


def duplicate_content(artefacts: DataFrame) -> DataFrame:
    """Files whose content another file already has, with the one to keep.

    Copies are counted map-side; the hashes with copies come back as a small
    side, and a hash with very many files stays spread over the scan.
    """
    hashed = artefacts.select("name", content_hash("content").alias("sha256"))
    copies = (
        hashed.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("name").alias("keep"))
        .filter("copies > 1")
    )
    return hashed.join(copies, "sha256").select("name", "sha256", "copies", "keep")


def inventory(files: DataFrame, words=POSITION_FILE_WORDS, types=POSITION_FILE_TYPES) -> DataFrame:
    """Candidate data files by word in the name and suffix (see ``sources``)."""
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    word = reduce(lambda a, b: a | b, [name.contains(w) for w in words])
    kind = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return files.filter(word & kind.isin(*types)).withColumn("file_name", name)


def inventory_summary(found: DataFrame) -> DataFrame:
    df = found.agg(F.count(F.lit(1)).alias("discovered_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return df.withColumn("available", F.when(F.col("discovered_files") > 0, "PARTIAL").otherwise("NO")).withColumn(
        "ready", F.when(F.col("discovered_files") > 0, "YES").otherwise("NO")
    )


def latest_analysis(results: DataFrame, analysis_id: str | None = None) -> DataFrame:
    """Latest completed result per case and module, or the one asked for."""
    done = results.filter("status = 'completed'")
    if analysis_id is not None:
        return done.filter(F.col("analysis_id") == analysis_id)
    last = done.groupBy("case_id", "module").agg(F.max("ordinal").alias("ordinal"))
    # The ordinal is unique, so the row comes back without a hot join key.
    return done.join(last.select("ordinal"), "ordinal", "left_semi")


def evidence_manifest(evidence: DataFrame, block: int = 1000) -> DataFrame:
    """Evidence ids per case and manifest list, in blocks of ``block`` items."""
    listing = F.lit("uncategorised")
    for kind, name in MANIFEST_LISTS.items():
        listing = F.when(F.col("evidence_type") == kind, name).otherwise(listing)
    df = evidence.withColumn("manifest_list", listing).withColumn("block", F.floor(F.col("ordinal") / block))
    return df.groupBy("case_id", "manifest_list", "block").agg(
        F.count(F.lit(1)).alias("items"),
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "evidence_id"))), lambda e: e["evidence_id"]).alias("ids"),
    )


def search_cases(cases: DataFrame, text: str, status: str = "ALL") -> DataFrame:
    """Case list by text in code, name or place, and by status choice."""
    q = text.lower()
    match = reduce(lambda a, b: a | b, [F.lower(c).contains(q) for c in ("case_code", "case_name", "location")])
    if status == "ALL":
        return cases.filter(match)
    chosen = F.col("status") == status
    if status == "DEMONSTRATION":
        chosen = chosen | F.col("mode").contains("Benchmark")
    return cases.filter(match & chosen)


def list_cases(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.col("created_s").desc(), "case_id")


def layer_union(layers: dict[str, DataFrame]) -> DataFrame:
    """One table of differently shaped layers, each row tagged with its layer."""
    tagged = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
