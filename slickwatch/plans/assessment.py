"""Queries on evaluation, dataset audits, provenance and case documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.functions.text import content_hash
from slickwatch.operators import evaluation as ev
from slickwatch.operators import provenance as pv
from slickwatch.plans.registry import Tables, query, rnd
from slickwatch.plans.views import ORACLE_VIEWS

EPS_METRICS = (
    f"{rnd('(2*tp+1e-6)/(2*tp+fp+fn+1e-6)')} AS dice, {rnd('(tp+1e-6)/(tp+fp+fn+1e-6)')} AS iou, "
    f"{rnd('(tp+1e-6)/(tp+fp+1e-6)')} AS precision, {rnd('(tp+1e-6)/(tp+fn+1e-6)')} AS recall"
)
COUNTS = """count(*) FILTER (p >= 0.5 AND truth) AS tp, count(*) FILTER (p >= 0.5 AND NOT truth) AS fp,
    count(*) FILTER (p < 0.5 AND truth) AS fn, count(*) FILTER (p < 0.5 AND NOT truth) AS tn"""


def _round(df: DataFrame, cols, digits=6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, geo.rnd(c, digits))
    return df


@query(
    "confusion_counts",
    f"SELECT scene_id, tp, fp, fn, tn, {EPS_METRICS} FROM (SELECT scene_id, {COUNTS} FROM v_predictions GROUP BY scene_id) q",
)
def confusion_counts(t):
    df = ev.confusion(t.view("v_predictions"), 0.5, ["scene_id"])
    return _round(df, ("dice", "iou", "precision", "recall"))


ORACLE_VIEWS["v_scene_counts"] = f"""
    SELECT category, scene_id, {COUNTS}, avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) AS share FROM v_predictions GROUP BY category, scene_id
"""


@query(
    "category_fp_report",
    f"""SELECT CASE WHEN a=1 THEN 'ALL' ELSE category END AS category, sample_count,
        {', '.join(f"CASE WHEN a=1 OR category='oil' THEN {m} END AS {n}" for m, n in (
            (rnd('(2*tp+1e-6)/(2*tp+fp+fn+1e-6)'), 'dice'), (rnd('(tp+1e-6)/(tp+fp+fn+1e-6)'), 'iou'),
            (rnd('(tp+1e-6)/(tp+fp+1e-6)'), 'precision'), (rnd('(tp+1e-6)/(tp+fn+1e-6)'), 'recall')))},
        {', '.join(f"CASE WHEN a=0 AND category<>'oil' THEN {rnd(n)} END AS {n}" for n in ('fp_scene_rate','mean_fraction','max_fraction','pct_above_limit'))}
        FROM (SELECT category, grouping(category) AS a, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
          count(*) AS sample_count, avg(CASE WHEN share > 0 THEN 1e0 ELSE 0e0 END) AS fp_scene_rate, avg(share) AS mean_fraction, max(share) AS max_fraction,
          avg(CASE WHEN share > 0.01e0 THEN 1e0 ELSE 0e0 END)*100 AS pct_above_limit FROM v_scene_counts GROUP BY ROLLUP (category)) q""",
)
def category_fp_report(t):
    df = ev.category_report(t.view("v_predictions"), 0.5)
    return _round(df, [c for c in df.columns if c not in ("category", "sample_count")])


@query(
    "classifier_report",
    f"""SELECT grp, tp, fp, fn, tn, {rnd('p')} AS precision, {rnd('r')} AS recall, {rnd('f')} AS false_positive_rate, {rnd('2*p*r/(p+r+1e-6)')} AS f1
        FROM (SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp+1e-6) END AS p, CASE WHEN tp+fp > 0 THEN tp/(tp+fn+1e-6) END AS r,
              CASE WHEN tp+fp > 0 THEN fp/(fp+tn+1e-6) END AS f FROM (
          SELECT lang AS grp, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn,
                 count(*) FILTER (NOT pred AND NOT truth) AS tn
          FROM (SELECT d.lang, quality=1 AND n_chars > 1000 AS pred, toxic=0 AS truth FROM labels l JOIN documents d ON d.doc_id=l.doc_id) z GROUP BY lang) c) q""",
)
def classifier_report(t):
    df = (
        t.table("labels")
        .join(t.table("documents").select("doc_id", "lang", "n_chars"), "doc_id")
        .select(
            F.col("lang").alias("grp"),
            ((F.col("quality") == 1) & (F.col("n_chars") > 1000)).alias("pred"),
            (F.col("toxic") == 0).alias("truth"),
        )
    )
    return _round(ev.classifier_report(df, ["grp"]), ("precision", "recall", "false_positive_rate", "f1"))


def pairs(t: Tables) -> DataFrame:
    """Images named by documents, masks by labels shifted by a few ids."""
    img = t.view("v_samples").select(
        F.col("doc_id").cast("string").alias("stem"), "category", (F.col("n_chars") % 97 + 1).alias("image_pixels")
    )
    msk = t.table("labels").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 100000000).otherwise(0)).cast("string").alias("stem"),
        (F.col("quality") * 40 + F.col("toxic") * 3).cast("bigint").alias("positive_pixels"),
        (F.col("doc_id") % 97 + 50).alias("mask_pixels"),
    )
    return ev.pair_by_stem(img, msk)


ORACLE_VIEWS["v_pairs"] = """
    SELECT coalesce(i.stem, m.stem) AS stem, i.category, i.image_pixels, m.positive_pixels, m.mask_pixels,
           CASE WHEN i.stem IS NULL THEN 'MASK_ONLY' WHEN m.stem IS NULL THEN 'IMAGE_ONLY' ELSE 'PAIRED' END AS pairing
    FROM (SELECT CAST(doc_id AS VARCHAR) AS stem, category, n_chars % 97 + 1 AS image_pixels FROM v_samples) i
    FULL JOIN (SELECT CAST(doc_id + CASE WHEN doc_id % 13 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) AS stem,
                      CAST(quality*40+toxic*3 AS BIGINT) AS positive_pixels, doc_id % 97 + 50 AS mask_pixels FROM labels) m ON m.stem=i.stem
"""


@query("pair_images_masks", "SELECT stem, pairing FROM v_pairs")
def pair_images_masks(t):
    return pairs(t).select("stem", "pairing")


@query("unmatched_sets", "SELECT stem, CASE WHEN pairing='IMAGE_ONLY' THEN 'A_MINUS_B' ELSE 'B_MINUS_A' END AS side FROM v_pairs WHERE pairing <> 'PAIRED'")
def unmatched_sets(t):
    """Stems on one side only: what one full join leaves unpaired."""
    a = t.view("v_samples").select(F.col("doc_id").cast("string").alias("stem"))
    b = t.table("labels").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 100000000).otherwise(0)).cast("string").alias("stem")
    )
    pairs = ev.pair_by_stem(a.distinct(), b.distinct()).filter("pairing <> 'PAIRED'")
    side = F.when(F.col("pairing") == "IMAGE_ONLY", "A_MINUS_B").otherwise("B_MINUS_A").alias("side")
    return pairs.select("stem", side)


@query(
    "dataset_audit",
    f"""SELECT coalesce(category, 'none') AS category, count(*) FILTER (pairing<>'MASK_ONLY') AS image_count, count(*) FILTER (pairing<>'IMAGE_ONLY') AS mask_count,
        count(*) FILTER (pairing='PAIRED') AS paired_samples, count(*) FILTER (pairing='IMAGE_ONLY') AS unmatched_images,
        count(*) FILTER (pairing='MASK_ONLY') AS unmatched_masks, count(*) FILTER (pairing='PAIRED' AND image_pixels<>mask_pixels) AS shape_mismatches,
        count(*) FILTER (pairing='PAIRED' AND positive_pixels=0) AS empty_masks,
        CAST(coalesce(sum(positive_pixels) FILTER (pairing='PAIRED'),0) AS BIGINT) AS oil_pixels,
        CAST(coalesce(sum(mask_pixels) FILTER (pairing='PAIRED'),0) AS BIGINT) AS total_pixels,
        {rnd("coalesce(count(*) FILTER (pairing='PAIRED' AND positive_pixels=0)/CAST(nullif(count(*) FILTER (pairing='PAIRED'),0) AS DOUBLE),0e0)*100")} AS empty_masks_pct,
        {rnd("coalesce(coalesce(sum(positive_pixels) FILTER (pairing='PAIRED'),0)/CAST(nullif(sum(mask_pixels) FILTER (pairing='PAIRED'),0) AS DOUBLE),0e0)*100")} AS oil_pixel_pct
        FROM v_pairs GROUP BY ALL""",
)
def dataset_audit(t):
    df = ev.dataset_audit(pairs(t).withColumn("category", F.coalesce("category", F.lit("none"))), ["category"])
    return _round(df, ("empty_masks_pct", "oil_pixel_pct"))


ORACLE_VIEWS["v_event"] = """
    SELECT *, CASE WHEN acquired IS NOT NULL THEN split_part(acquired, 'T', 1)
                   ELSE split_part(scene_id,'_',1) || '_' || split_part(scene_id,'_',2) END AS event_id FROM v_samples
"""
ORACLE_VIEWS["v_split_keys"] = """
    SELECT DISTINCT split, 'scene' AS kind, scene_id AS key FROM v_samples UNION ALL SELECT DISTINCT split, 'event', event_id FROM v_event
"""
LEAK = """FROM v_split_keys a JOIN v_split_keys b ON a.kind=b.kind AND a.key=b.key JOIN (VALUES ('train','val'),('train','test'),('val','test')) p(x,y)
    ON a.split=p.x AND b.split=p.y"""


@query("event_id_derive", "SELECT doc_id, event_id FROM v_event")
def event_id_derive(t):
    from slickwatch.functions.text import event_id

    return t.view("v_samples").select("doc_id", event_id("acquired", "scene_id").alias("event_id"))


@query("split_leakage", f"SELECT a.kind, a.split || '_' || b.split AS pair, count(*) AS leaked {LEAK} GROUP BY ALL")
def split_leakage(t):
    return ev.leakage_summary(t.view("v_samples"))


@query("split_intersections", f"SELECT a.kind, a.split || '_' || b.split AS pair, a.key {LEAK}")
def split_intersections(t):
    return ev.split_leakage(t.view("v_samples"))


@query(
    "train_val_split",
    """SELECT doc_id, CASE WHEN r <= n - greatest(1, least(n-1, CAST(floor(n*0.2e0) AS BIGINT))) THEN 'train' ELSE 'val' END AS split
       FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents) q""",
)
def train_val_split(t):
    return ev.seeded_split(t.table("documents").select("doc_id"), "doc_id", "42").select("doc_id", "split")


# --- provenance --------------------------------------------------------------


@query("sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def sha256(t):
    return t.table("pages").select("page_id", content_hash("html").alias("digest"))


@query(
    "hash_manifest",
    """SELECT e.name, coalesce(sha256(p.html), 'FILE_NOT_FOUND') AS sha256 FROM (SELECT 'page-' || CAST(page_id + CASE WHEN page_id % 9 = 2 THEN 1000000 ELSE 0 END AS VARCHAR) AS name FROM pages) e
       LEFT JOIN (SELECT 'page-' || CAST(page_id AS VARCHAR) AS name, html FROM pages) p ON p.name=e.name""",
)
def hash_manifest(t):
    page = t.table("pages")
    shift = F.when(F.col("page_id") % 9 == 2, 1000000).otherwise(0)
    expected = page.select(F.concat(F.lit("page-"), (F.col("page_id") + shift).cast("string")).alias("name"))
    have = page.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("content"))
    return pv.hash_manifest(expected, have)


@query(
    "freeze_verify",
    """SELECT coalesce(f.name, c.name) AS name, CASE WHEN f.name IS NULL THEN 'NEW' WHEN c.name IS NULL THEN 'MISSING' WHEN f.h=c.h THEN 'SAME' ELSE 'CHANGED' END AS freeze_status
       FROM (SELECT doc_id + CASE WHEN doc_id % 11 = 3 THEN 1000000 ELSE 0 END AS name, sha256(text) AS h FROM documents) f
       FULL JOIN (SELECT doc_id AS name, sha256(text || CASE WHEN doc_id % 7 = 5 THEN '!' ELSE '' END) AS h FROM documents) c ON c.name=f.name""",
)
def freeze_verify(t):
    docs = t.table("documents")
    frozen = docs.select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 11 == 3, 1000000).otherwise(0)).alias("name"), content_hash("text").alias("sha256")
    )
    edited = F.concat("text", F.when(F.col("doc_id") % 7 == 5, "!").otherwise(""))
    current = docs.select(F.col("doc_id").alias("name"), content_hash(edited).alias("sha256"))
    return pv.freeze_verify(frozen, current)


TERMS = ("culprit", "guilty", "proven source", "ai confidence", "the th", "license")
PATTERNS = ("ofthe", "ais_accessed=true")


def _len_hits(text, term):
    return f"(length({text})-length(replace({text}, '{term}', '')))//{len(term)}"


@query(
    "forbidden_scan",
    f"""SELECT doc_id, CAST({' + '.join([_len_hits('low', x) for x in TERMS] + [_len_hits('tight', x) for x in PATTERNS])} AS INTEGER) AS hits,
        CASE WHEN {' OR '.join([f"contains(low, '{x}')" for x in TERMS] + [f"contains(tight, '{x}')" for x in PATTERNS])} THEN 'FAIL' ELSE 'PASS' END AS audit
        FROM (SELECT doc_id, lower(text) AS low, replace(lower(text), ' ', '') AS tight FROM documents) d""",
)
def forbidden_scan(t):
    return pv.forbidden_scan(t.table("documents"), TERMS, PATTERNS).select("doc_id", "hits", "audit")


@query(
    "lineage_resolve",
    """SELECT grp, CASE WHEN a AND NOT b THEN 'src1' WHEN b AND NOT a THEN 'src2' ELSE 'AMBIGUOUS' END AS product,
       CASE WHEN a <> b THEN 'PASS' ELSE 'BLOCKED_PROVENANCE' END AS lineage_status
       FROM (SELECT n_chars % 500 AS grp, bool_or(contains(vv_path,'src1')) AS a, bool_or(contains(vv_path,'src2')) AS b FROM v_samples GROUP BY 1) q""",
)
def lineage_resolve(t):
    files = t.view("v_samples").select((F.col("n_chars") % 500).alias("grp"), F.col("vv_path").alias("file_name"))
    return pv.lineage(files, ("src1", "src2"), ["grp"])


@query(
    "data_mode",
    """SELECT case_id, CASE WHEN case_id % 4 = 0 AND case_id % 3 <> 0 THEN 'REAL_HISTORICAL' ELSE 'SYNTHETIC_DEMO' END AS data_mode,
       case_id % 4 = 0 AND case_id % 3 <> 0 AS historical_attribution_valid FROM v_case_list""",
)
def data_mode(t):
    ready = F.when(F.col("case_id") % 4 == 0, "YES").otherwise("NO")
    there = F.when(F.col("case_id") % 3 != 0, "YES")
    mode, ok = pv.data_mode(ready, there)
    return t.view("v_case_list").select("case_id", mode.alias("data_mode"), ok.alias("historical_attribution_valid"))


@query(
    "dup_content",
    """SELECT d.name, d.h AS sha256, c.copies, c.keep FROM (SELECT doc_id AS name, sha256(text) AS h FROM documents) d JOIN
       (SELECT sha256(text) AS h, count(*) AS copies, min(doc_id) AS keep FROM documents GROUP BY 1 HAVING count(*) > 1) c ON c.h=d.h""",
)
def dup_content(t):
    return pv.duplicate_content(t.table("documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content")))


# --- case documents ------------------------------------------------------------


@query(
    "latest_analysis",
    """SELECT case_id, module, analysis_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, module ORDER BY ordinal DESC) AS r
       FROM v_results WHERE status='completed') q WHERE r=1""",
)
def latest_analysis(t):
    return pv.latest_analysis(t.view("v_results")).select("case_id", "module", "analysis_id", "score")


@query(
    "evidence_manifest",
    """SELECT case_id, l AS manifest_list, CAST(floor(ordinal/1000e0) AS BIGINT) AS block, count(*) AS items, string_agg(evidence_id, ',' ORDER BY ordinal) AS ids
       FROM (SELECT *, CASE evidence_type WHEN 'sar_image' THEN 'satellite_imagery' WHEN 'ais' THEN 'ais_data' WHEN 'met_ocean' THEN 'met_ocean_data'
             ELSE 'uncategorised' END AS l FROM v_evidence) q GROUP BY case_id, l, floor(ordinal/1000e0)""",
)
def evidence_manifest(t):
    return pv.evidence_manifest(t.view("v_evidence")).withColumn("ids", F.concat_ws(",", "ids"))


@query("list_cases", "SELECT case_id, case_code, created_s FROM v_case_list ORDER BY created_s DESC, case_id")
def list_cases(t):
    return pv.list_cases(t.view("v_case_list")).select("case_id", "case_code", "created_s")


@query(
    "case_search",
    """SELECT case_id, case_code, status, mode FROM v_case_list WHERE (contains(lower(case_code),'11') OR contains(lower(case_name),'11')
       OR contains(lower(location),'11')) AND (status='DEMONSTRATION' OR contains(mode,'Benchmark'))""",
)
def case_search(t):
    return pv.search_cases(t.view("v_case_list"), "11", "DEMONSTRATION").select("case_id", "case_code", "status", "mode")


@query(
    "distinct_groups",
    """SELECT scene_id, count(DISTINCT group_id) AS groups_seen, count(DISTINCT group_id) >= 5 AS diverse FROM v_candidates GROUP BY scene_id""",
)
def distinct_groups(t):
    df = t.view("v_candidates").groupBy("scene_id").agg(F.countDistinct("group_id").alias("groups_seen"))
    return df.withColumn("diverse", F.col("groups_seen") >= 5)


@query(
    "layer_union",
    f"""SELECT 'candidates' AS layer, candidate_id AS feature_id, {rnd('area_km2')} AS area_km2, NULL::INTEGER AS horizon_hours, NULL::VARCHAR AS mmsi FROM v_candidates
        UNION ALL SELECT 'regions', candidate_id, NULL, horizon_hours, NULL FROM v_regions
        UNION ALL SELECT 'positions', CAST(ordinal AS VARCHAR), NULL, NULL, mmsi FROM v_positions""",
)
def layer_union(t):
    return pv.layer_union(
        {
            "candidates": t.view("v_candidates").select(F.col("candidate_id").alias("feature_id"), geo.rnd("area_km2", 6).alias("area_km2")),
            "regions": t.view("v_regions").select(F.col("candidate_id").alias("feature_id"), "horizon_hours"),
            "positions": t.view("v_positions").select(F.col("ordinal").cast("string").alias("feature_id"), "mmsi"),
        }
    )
