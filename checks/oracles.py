"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from reviewmill.constants import STOP_WORDS
from reviewmill.functions.minhash import BASE, PRIME, band_layout, permutations

from .views import CATEGORIES, SQL, TEN_LABELS, flag_sql

_WS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
_ELONGATED = "|".join(f"{c}{{3,}}" for c in _ALNUM)


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{_WS}]+'))"


def _normalize(c: str, mode: str = "drop") -> str:
    text = f"regexp_replace(lower({c}), 'http[^{_WS}]+|www\\.[^{_WS}]+', '', 'g')"
    if mode == "drop":
        text = f"regexp_replace({text}, '{_ELONGATED}', ' ', 'g')"
    else:
        for ch in _ALNUM:
            text = f"regexp_replace({text}, '{ch}{{3,}}', '{ch}', 'g')"
    return f"trim(regexp_replace(regexp_replace({text}, '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def _sample(source: str, by: str, size: str, seed: int) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT *, row_number() OVER ({part} ORDER BY md5(concat('{seed}:', review_id)), review_id)
          <= {size.format(n=f"count(*) OVER ({part})")} AS taken
FROM {source}"""


_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations()))
_BANDS, _ROWS = band_layout()


def _greedy(pairs: str) -> dict[str, str]:
    """Sequential greedy over rows in id order, given (lo, hi) match pairs of ``cleaned``."""
    return {
        "ranked": f"""
SELECT c.review_id, row_number() OVER (ORDER BY c.review_id) AS rn,
       coalesce((SELECT list(lo) FROM {pairs} p WHERE p.hi = c.review_id), []) AS lower_ids
FROM cleaned c""",
        "walk(rn, kept)": """
SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
UNION ALL
SELECT o.rn, CASE WHEN list_has_any(w.kept, o.lower_ids) THEN w.kept
                  ELSE list_append(w.kept, o.review_id) END
FROM walk w JOIN ranked o ON o.rn = w.rn + 1""",
        "keepers": "SELECT unnest(kept) AS review_id FROM walk WHERE rn = (SELECT max(rn) FROM walk)",
    }


CTE = {
    **SQL,
    "cleaned": f"""
SELECT review_id, user_name, score, {_normalize('content')} AS content
FROM reviews WHERE {_words('content')} >= 6""",
    "exact": """
SELECT * FROM cleaned WHERE review_id IN (SELECT min(review_id) FROM cleaned GROUP BY content)""",
    "chars": "SELECT review_id, string_split(content, '') AS c FROM cleaned",
    "shingles": """
SELECT review_id, c[i] || c[i + 1] || c[i + 2] AS s
FROM (SELECT review_id, c, unnest(range(1, len(c) - 1)) AS i FROM chars)""",
    "points": """
SELECT review_id, list_transform(c, lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM chars""",
    "codes": f"""
SELECT review_id, (x4 * x) % {PRIME} AS x FROM (
  SELECT review_id, x, (((x * x) % {PRIME}) * ((x * x) % {PRIME})) % {PRIME} AS x4 FROM (
    SELECT DISTINCT review_id, ((u[i] * {BASE} + u[i + 1]) % {PRIME} * {BASE} + u[i + 2]) % {PRIME} AS x
    FROM (SELECT review_id, u, unnest(range(1, len(u) - 1)) AS i FROM points)))""",
    "perms(i, a, b)": f"SELECT * FROM (VALUES {_PERMS}) t(i, a, b)",
    "sig": f"""
SELECT c.review_id, p.i, coalesce(m.v, {PRIME}) AS v
FROM cleaned c CROSS JOIN perms p
LEFT JOIN (SELECT review_id, i, min((x * a + b) % {PRIME}) AS v FROM codes, perms GROUP BY ALL) m
  ON m.review_id = c.review_id AND m.i = p.i""",
    "bands": f"""
SELECT review_id, i // {_ROWS} AS band, string_agg(v, ',' ORDER BY i) AS bucket
FROM sig WHERE i < {_BANDS * _ROWS} GROUP BY ALL""",
    "candidates": """
SELECT DISTINCT a.review_id AS lo, b.review_id AS hi
FROM bands a JOIN bands b ON a.band = b.band AND a.bucket = b.bucket AND a.review_id < b.review_id""",
    "sets": """
SELECT c.review_id, coalesce(s.items, []) AS items FROM cleaned c
LEFT JOIN (SELECT review_id, list(DISTINCT s) AS items FROM shingles GROUP BY 1) s USING (review_id)""",
    "alike": """
SELECT lo, hi, CASE WHEN len(a.items) + len(b.items) = 0 THEN 1.0E0
       ELSE len(list_intersect(a.items, b.items)) * 1.0E0
            / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) END AS jaccard
FROM candidates JOIN sets a ON a.review_id = lo JOIN sets b ON b.review_id = hi""",
    "verified": "SELECT * FROM alike WHERE jaccard >= 0.85",
    "tokens": "SELECT review_id, score, {tokens} AS t FROM normalized".replace(
        "{tokens}",
        "list_filter(regexp_extract_all(content, '[a-z0-9]{2,}'), lambda x: x NOT IN ("
        + ", ".join(f"'{w}'" for w in STOP_WORDS)
        + "))",
    ),
    "normalized": f"""
SELECT review_id, user_name, score, {_normalize('content')} AS content FROM reviews""",
    "grams": """
SELECT review_id, score, t[i] || ' ' || t[i + 1] AS term
FROM (SELECT review_id, score, t, unnest(range(1, len(t))) AS i FROM tokens)
UNION ALL
SELECT review_id, score, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]
FROM (SELECT review_id, score, t, unnest(range(1, len(t) - 1)) AS i FROM tokens)""",
    "tf": "SELECT review_id, score, term, count(*) AS tf FROM grams GROUP BY ALL",
    "idf": """
SELECT term, ln((1.0E0 + (SELECT count(*) FROM reviews)) / (count(*) + 1)) + 1 AS idf
FROM tf GROUP BY term""",
    "tfidf": """
SELECT review_id, score, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY review_id)) AS weight
FROM (SELECT review_id, score, tf.term, tf * idf AS raw FROM tf JOIN idf ON tf.term = idf.term)""",
    "weights": """
SELECT term, round(sum(weight) / (SELECT count(*) FROM reviews), 8) AS weight,
  round(coalesce(sum(weight) FILTER (score <= 2), 0.0E0)
        / (SELECT count(*) FROM reviews WHERE score <= 2), 8) AS neg_mean_weight,
  round(coalesce(sum(weight) FILTER (score >= 4), 0.0E0)
        / (SELECT count(*) FROM reviews WHERE score >= 4), 8) AS pos_mean_weight
FROM tfidf GROUP BY term""",
    "golden_marked": _sample(
        "reviews", "score", "round_even((50.2E0 / (SELECT count(*) FROM reviews)) * {n}, 0)", 12
    ),
    "golden": "SELECT * EXCLUDE taken FROM golden_marked WHERE taken",
    "rest": "SELECT * EXCLUDE taken FROM golden_marked WHERE NOT taken",
    "few_marked": _sample(
        "rest", "score", "round_even((10.0E0 / (SELECT count(*) FROM rest)) * {n}, 0)", 12
    ),
    "split": _sample("gold_reviews", "LOW_QUALITY, TOXIC", "floor(0.2E0 * {n} + 0.5)", 12),
    "shot_marked": _sample(
        "gold_reviews", "score",
        "round_even((10.0E0 / (SELECT count(*) FROM gold_reviews)) * {n}, 0)", 12,
    ),
    "shots": """
SELECT *, row_number() OVER (ORDER BY review_id) AS k FROM shot_marked WHERE taken""",
    "blocks": f"""
SELECT k AS example, concat('### Example ', k, chr(10), '**Review:**', chr(10), '"',
  replace(regexp_replace(content, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '"', '\\"'), '"', chr(10), chr(10),
  '**Output:**', chr(10), '```json', chr(10), '{{', chr(10),
  '  "LOW_QUALITY": "', LOW_QUALITY, '",', chr(10), '  "TOXIC": "', TOXIC, '"', chr(10), '}}',
  chr(10), '```', chr(10)) AS block
FROM shots""",
    "chunked": """
SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS row_id,
       (row_number() OVER (ORDER BY review_id) - 1) // 100 AS chunk_id
FROM gold""",
    "answers": """
SELECT review_id,
  CASE WHEN review_id % 17 = 0 OR review_id % 19 = 0 THEN 'ERROR' ELSE LOW_QUALITY END AS LOW_QUALITY_pred,
  CASE WHEN review_id % 17 = 0 OR review_id % 19 = 0 OR review_id % 13 = 0 THEN 'ERROR'
       ELSE TOXIC END AS TOXIC_pred
FROM gold WHERE review_id % 29 <> 0""",
    "probs": """
SELECT review_id, LOW_QUALITY_logit, TOXIC_logit,
  1 / (1 + exp(-LOW_QUALITY_logit)) AS LOW_QUALITY_prob, 1 / (1 + exp(-TOXIC_logit)) AS TOXIC_prob
FROM scores""",
    "predicted": """
SELECT p.*, g.LOW_QUALITY, g.TOXIC,
  CASE WHEN LOW_QUALITY_prob >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS LOW_QUALITY_pred,
  CASE WHEN TOXIC_prob >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS TOXIC_pred
FROM probs p JOIN gold g USING (review_id)""",
    "runs": """
SELECT 'scorer' AS model, review_id, LOW_QUALITY, TOXIC, LOW_QUALITY_pred, TOXIC_pred FROM predicted
UNION ALL
SELECT 'answers', g.review_id, LOW_QUALITY, TOXIC, LOW_QUALITY_pred, TOXIC_pred
FROM gold g JOIN answers a USING (review_id)""",
    "long": """
SELECT model, 'LOW_QUALITY' AS category, LOW_QUALITY AS truth, LOW_QUALITY_pred AS p FROM runs
UNION ALL SELECT model, 'TOXIC', TOXIC, TOXIC_pred FROM runs""",
    "per_label": """
SELECT model, category, label, count(*) FILTER (truth = label) AS support,
       count(*) FILTER (p = label) AS predicted, count(*) FILTER (truth = label AND p = label) AS hit
FROM long, (VALUES ('NEG'), ('ABSENT'), ('ERROR')) l(label) GROUP BY ALL""",
    "report": """
SELECT model, category, avg(2.0E0 * hit / (support + predicted)) FILTER (support + predicted > 0) AS macro_f1,
  coalesce(max(hit * 1.0E0 / nullif(support, 0)) FILTER (label = 'ABSENT'), 0.0E0) AS absent_recall,
  coalesce(max(hit * 1.0E0 / nullif(support, 0)) FILTER (label = 'NEG'), 0.0E0) AS neg_recall
FROM per_label GROUP BY ALL""",
    "exact_rows": """
SELECT model, count(*) AS "rows",
  avg(CASE WHEN LOW_QUALITY = LOW_QUALITY_pred AND TOXIC = TOXIC_pred THEN 1.0E0 ELSE 0.0E0 END)
    AS exact_match_ratio
FROM runs GROUP BY model""",
    "metric_rows": """
SELECT model, 'PRIMARY' AS section, category || '_macro_f1' AS metric, macro_f1 AS value FROM report
UNION ALL SELECT model, 'DIAGNOSTIC', category || '_absent_recall', absent_recall FROM report
UNION ALL SELECT model, 'DIAGNOSTIC', category || '_neg_recall', neg_recall FROM report
UNION ALL SELECT model, 'PRIMARY', 'macro_f1_mean', avg(macro_f1) FROM report GROUP BY model
UNION ALL SELECT model, 'SECONDARY', 'exact_match_ratio', exact_match_ratio FROM exact_rows""",
    "scored_text": """
SELECT review_id, content, 1 / (1 + exp(-((length(content) % 23 - 11) / 4.0E0))) AS p1,
       1 / (1 + exp(-((length(content) % 29 - 14) / 4.0E0))) AS p2 FROM reviews""",
}

_GREEDY_CTE = _greedy("candidates")
_VERIFIED_CTE = _greedy("verified")
_REVIEW = ["reviews"]
_CLEAN = ["reviews", "cleaned"]
_LSH = [*_CLEAN, "chars", "points", "codes", "perms(i, a, b)", "sig", "bands"]
_GOLD = ["reviews", "gold", "gold_reviews"]
_ANSWERS = ["gold", "answers"]
_PREDICTED = ["gold", "scores", "probs", "predicted"]
_RUNS = [*_PREDICTED, "answers", "runs"]
_REPORT = [*_RUNS, "long", "per_label", "report", "exact_rows", "metric_rows"]
_TERMS = ["reviews", "normalized", "tokens", "grams", "tf", "idf", "tfidf", "weights"]


def _q(names: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    defs = [(n, CTE[n]) for n in names] + list((extra or {}).items())
    if not any(n.startswith("walk") for n, _ in defs):
        return "WITH " + ",\n".join(f"{n} AS ({d})" for n, d in defs) + "\n" + select
    # Without MATERIALIZED the recursion would compute its inputs again at every step.
    kept = ("cleaned", "bands", "candidates", "ranked")
    return (
        "WITH RECURSIVE "
        + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in kept)}({d})" for n, d in defs)
        + "\n" + select
    )


def _iterative_sizes() -> dict[str, str]:
    """CTEs up to ``sizes`` (mask, v): one step per label, the one with the fewest open rows each time."""
    bits = [f"CASE WHEN {c} = 'NEG' THEN {1 << i} ELSE 0 END" for i, c in enumerate(CATEGORIES)]
    bits += [f"CASE WHEN {flag_sql(c)} THEN {1 << i} ELSE 0 END" for i, c in enumerate(TEN_LABELS) if c not in CATEGORIES]
    out = {
        "masks": f"SELECT review_id, {' + '.join(bits)} AS mask FROM gold_reviews",
        "t0": "SELECT mask, count(*) AS n, CAST(NULL AS BIGINT) AS v FROM masks GROUP BY mask",
    }
    k = len(TEN_LABELS)
    for i in range(k):
        out[f"p{i}"] = (
            "SELECT l, left_n, greatest(0, least(left_n, CAST(floor(0.2E0 * n + 0.5) AS BIGINT) - got)) AS need FROM "
            "(SELECT l, sum(n) AS n, coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS left_n, coalesce(sum(v), 0) AS got "
            f"FROM t{i}, (SELECT unnest(range({k})) AS l) WHERE (mask >> l) & 1 = 1 GROUP BY l) WHERE left_n > 0 "
            "ORDER BY left_n, l LIMIT 1"
        )
        out[f"m{i}"] = f"SELECT mask, n, v, left_n, need, v IS NULL AND l IS NOT NULL AND (mask >> l) & 1 = 1 AS now FROM t{i} LEFT JOIN p{i} ON true"
        out[f"t{i + 1}"] = (
            "SELECT mask, n, CASE WHEN NOT now THEN v ELSE need * n // left_n + CAST(row_number() OVER "
            "(PARTITION BY now ORDER BY need * n % left_n DESC, mask) <= need - sum(need * n // left_n) OVER "
            f"(PARTITION BY now) AS BIGINT) END AS v FROM m{i}"
        )
    out["sizes"] = (
        f"SELECT mask, CASE WHEN mask > 0 THEN v ELSE greatest(0, least(n, CAST(floor(0.2E0 * (SELECT sum(n) FROM t{k}) + 0.5) "
        f"AS BIGINT) - (SELECT coalesce(sum(v), 0) FROM t{k}))) END AS v FROM t{k}"
    )
    return out


_TRIAGE = """
SELECT review_id, content,
  CASE WHEN p1 >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS low_quality_label,
  round_even(p1, 4) AS low_quality_probability,
  CASE WHEN p2 >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS toxic_label,
  round_even(p2, 4) AS toxic_probability,
  concat_ws(',', CASE WHEN p1 >= 0.5 THEN 'LOW_QUALITY' END,
                 CASE WHEN p2 >= 0.5 THEN 'TOXIC' END) AS active_complaints
FROM scored_text"""


def oracle_sql() -> dict[str, str]:
    best = "SELECT run, epoch, val_macro_f1_mean FROM epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_macro_f1_mean {}, epoch) = 1"
    top = "SELECT * FROM weights ORDER BY {} DESC, term LIMIT 40"
    out: dict[str, str] = {}

    # text and filters
    out["clean_exact"] = _q([*_CLEAN, "exact"], "SELECT * FROM exact")
    out["clean_score_counts"] = _q(
        [*_CLEAN, "exact"], "SELECT score, count(*) AS n FROM exact GROUP BY score"
    )
    out["length_filter"] = _q(
        _REVIEW, f"SELECT review_id, {_words('content')} AS n_words FROM reviews WHERE {_words('content')} >= 6"
    )
    for mode in ("drop", "collapse"):
        out[f"normalize_{mode}"] = _q(
            _REVIEW, f"SELECT review_id, {_normalize('content', mode)} AS content FROM reviews"
        )
    out["newest_reviews"] = """
SELECT event_id AS review_id, ts AS reviewed_at, event_type AS content FROM events
ORDER BY ts DESC, event_id LIMIT 1000"""
    out["score_filter"] = _q(
        _REVIEW,
        "SELECT review_id, score FROM reviews WHERE score <= 3 UNION ALL "
        "SELECT review_id, score FROM top WHERE taken",
        {"top": _sample("(SELECT * FROM reviews WHERE score >= 4)", "", "round_even(0.1E0 * {n}, 0)", 32)},
    )
    out["char_shingles"] = _q(
        [*_CLEAN, "chars", "shingles"],
        "SELECT s AS shingle, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM shingles GROUP BY s",
    )
    out["distinct_shingles"] = _q(
        [*_CLEAN, "chars", "shingles", "sets"],
        "SELECT review_id, len(items) AS n_distinct FROM sets",
    )
    out["null_to_empty"] = """
SELECT doc_id AS review_id, text AS content, CASE WHEN lang = 'en' THEN text ELSE '' END AS english FROM documents"""
    out["head_preview"] = _q(_REVIEW, "SELECT * FROM reviews ORDER BY review_id LIMIT 2")

    # near duplicates
    out["minhash_signature"] = _q(
        _LSH[:-1], "SELECT review_id, string_agg(v, ',' ORDER BY i) AS signature FROM sig GROUP BY review_id"
    )
    out["lsh_bands"] = _q(
        _LSH, "SELECT CAST(band AS INT) AS band, count(DISTINCT bucket) AS n_buckets FROM bands GROUP BY band"
    )
    out["greedy_near_dedup"] = _q(
        [*_LSH, "candidates"],
        "SELECT c.* FROM cleaned c JOIN keepers USING (review_id)", _GREEDY_CTE,
    )
    out["clean_reviews"] = _q(
        [*_LSH, "candidates"],
        "SELECT c.score, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars "
        "FROM cleaned c JOIN keepers USING (review_id) GROUP BY score", _GREEDY_CTE,
    )
    out["near_dup_matches"] = _q(
        [*_LSH, "candidates", "shingles", "sets", "alike"],
        "SELECT hi AS review_id, lo AS kept_id, round(jaccard, 8) AS jaccard "
        "FROM alike JOIN keepers k ON k.review_id = lo", _GREEDY_CTE,
    )
    out["greedy_near_dedup_verified"] = _q(
        [*_LSH, "candidates", "shingles", "sets", "alike", "verified"],
        "SELECT c.review_id, c.content FROM cleaned c JOIN keepers USING (review_id)", _VERIFIED_CTE,
    )

    alike = [*_CLEAN, "chars", "shingles", "sets"]
    classes = {
        "classes": "SELECT review_id, items, min(review_id) OVER (PARTITION BY list_sort(items)) AS class_id FROM sets",
        "firsts": "SELECT review_id AS id, items, len(items) AS n FROM classes WHERE review_id = class_id",
        "compared": "SELECT a.id AS class_id, b.id AS similar_id, len(list_intersect(a.items, b.items)) AS c, "
        "a.n + b.n AS n FROM firsts a JOIN firsts b ON a.id < b.id "
        "AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) AND a.n > 0",
        "pairs": "SELECT class_id, similar_id, round(c * 1.0E0 / (n - c), 8) AS jaccard FROM compared "
        "WHERE 100 * c >= 85 * (n - c)",
    }
    out["similar_classes"] = _q(alike, "SELECT review_id, class_id FROM classes", classes)
    out["similar_pairs"] = _q(alike, "SELECT * FROM pairs", classes)
    out["similar_lookup"] = _q(
        alike,
        "SELECT review_id, class_id, 1.0E0 AS jaccard FROM classes WHERE review_id % 100 = 0 UNION ALL "
        "SELECT c.review_id, p.similar_id, p.jaccard FROM classes c JOIN pairs p USING (class_id) "
        "WHERE c.review_id % 100 = 0 UNION ALL "
        "SELECT c.review_id, p.class_id, p.jaccard FROM classes c JOIN pairs p ON p.similar_id = c.class_id "
        "WHERE c.review_id % 100 = 0",
        classes,
    )

    # counts
    out["value_counts"] = _q(_REVIEW, "SELECT user_name, count(*) AS n FROM reviews GROUP BY user_name")
    out["composition"] = _q(
        _REVIEW,
        "SELECT score, count(*) AS n, count(*) / (SELECT count(*) FROM reviews) AS share FROM reviews GROUP BY score",
    )
    out["label_distribution"] = _q(
        ["gold"],
        "SELECT 'LOW_QUALITY' AS category, LOW_QUALITY AS label, count(*) AS n FROM gold GROUP BY ALL "
        "UNION ALL SELECT 'TOXIC', TOXIC, count(*) FROM gold GROUP BY ALL",
    )

    # label columns and validation
    out["project_labels"] = _q(
        [*_GOLD, "answers"],
        "SELECT content, LOW_QUALITY_pred AS LOW_QUALITY, TOXIC_pred AS TOXIC "
        "FROM gold_reviews JOIN answers USING (review_id)",
    )
    out["rename_predictions"] = _q(
        ["gold"], "SELECT review_id, LOW_QUALITY AS LOW_QUALITY_pred, TOXIC AS TOXIC_pred FROM gold"
    )
    out["null_label_columns"] = _q(
        _REVIEW,
        "SELECT review_id, content, CAST(NULL AS VARCHAR) AS LOW_QUALITY, CAST(NULL AS VARCHAR) AS TOXIC FROM reviews",
    )
    out["validate_good"] = _q(
        _ANSWERS, "SELECT * FROM answers WHERE LOW_QUALITY_pred <> 'ERROR' AND TOXIC_pred <> 'ERROR'"
    )
    out["validate_quarantine"] = _q(
        _ANSWERS,
        "SELECT *, concat_ws(',', CASE WHEN LOW_QUALITY_pred = 'ERROR' THEN 'LOW_QUALITY_pred' END, "
        "CASE WHEN TOXIC_pred = 'ERROR' THEN 'TOXIC_pred' END) AS failed_checks FROM answers "
        "WHERE LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR'",
    )
    out["validate_requests"] = """
SELECT doc_id AS review_id, doc_id % 7 / 5.0E0 AS threshold FROM documents
WHERE length(text) >= 1 AND doc_id % 7 / 5.0E0 BETWEEN 0 AND 1"""
    out["encode_labels"] = _q(
        _ANSWERS,
        "SELECT review_id, CAST(LOW_QUALITY_pred = 'NEG' AS BIGINT) AS LOW_QUALITY_pred, "
        "CAST(TOXIC_pred = 'NEG' AS BIGINT) AS TOXIC_pred FROM answers "
        "WHERE LOW_QUALITY_pred <> 'ERROR' AND TOXIC_pred <> 'ERROR'",
    )
    out["decode_labels"] = """
SELECT doc_id AS review_id, CASE quality WHEN 0 THEN 'ABSENT' ELSE 'NEG' END AS quality,
       CASE toxic + quality WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'NEG' ELSE '2' END AS total FROM labels"""

    # samples, splits, numbering
    out["stratified_golden"] = _q([*_REVIEW, "golden_marked", "golden"], "SELECT * FROM golden")
    out["stratified_few_shot"] = _q(
        [*_REVIEW, "golden_marked", "rest", "few_marked"],
        "SELECT * EXCLUDE taken FROM few_marked WHERE taken",
    )
    out["holdout_pool"] = _q(
        [*_REVIEW, "golden_marked", "rest", "few_marked"],
        "SELECT * EXCLUDE taken FROM few_marked WHERE NOT taken",
    )
    out["multilabel_split"] = _q(
        [*_GOLD, "split"],
        "SELECT review_id, LOW_QUALITY, TOXIC, CASE WHEN taken THEN 'valid' ELSE 'train' END AS split FROM split",
    )
    out["multilabel_split_iterative"] = _q(
        [*_GOLD],
        "SELECT review_id, CASE WHEN row_number() OVER (PARTITION BY mask ORDER BY md5(concat('12:', review_id)), review_id) "
        "<= v THEN 'valid' ELSE 'train' END AS split FROM masks JOIN sizes USING (mask)",
        _iterative_sizes(),
    )
    out["label_rates"] = _q(
        [*_GOLD, "split"],
        "SELECT CASE WHEN taken THEN 'valid' ELSE 'train' END AS split, 'LOW_QUALITY' AS category, "
        "LOW_QUALITY AS label, count(*) AS n FROM split GROUP BY ALL UNION ALL "
        "SELECT CASE WHEN taken THEN 'valid' ELSE 'train' END, 'TOXIC', TOXIC, count(*) FROM split GROUP BY ALL",
    )
    out["build_splits"] = _q(
        [*_GOLD, "answers", "normalized"],
        "SELECT review_id, CASE WHEN taken THEN 'valid' ELSE 'train' END AS split, "
        "CAST(LOW_QUALITY = 'NEG' AS BIGINT) AS LOW_QUALITY, CAST(TOXIC = 'NEG' AS BIGINT) AS TOXIC "
        "FROM pool_split UNION ALL SELECT review_id, 'test', CAST(LOW_QUALITY = 'NEG' AS BIGINT), "
        "CAST(TOXIC = 'NEG' AS BIGINT) FROM gold_reviews WHERE score = 5",
        {
            "pool": "SELECT review_id, LOW_QUALITY_pred AS LOW_QUALITY, TOXIC_pred AS TOXIC FROM answers "
            "JOIN reviews USING (review_id) WHERE score < 5 AND LOW_QUALITY_pred <> 'ERROR' AND TOXIC_pred <> 'ERROR' "
            "AND review_id NOT IN (SELECT review_id FROM normalized WHERE content IN (SELECT n.content "
            "FROM normalized n JOIN gold_reviews g USING (review_id) WHERE g.score = 5))",
            "pool_split": _sample("pool", "LOW_QUALITY, TOXIC", "floor(0.2E0 * {n} + 0.5)", 12),
        },
    )
    names = ("train", "valid", "test")
    audit = [f"SELECT 'rows' AS metric, '{a}' AS split, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS VARCHAR) AS category, "
             f"CAST(count(*) AS DOUBLE) AS value FROM audited WHERE split = '{a}'" for a in names]
    audit += [f"SELECT 'texts', '{a}', NULL, NULL, count(DISTINCT content) FROM audited WHERE split = '{a}'" for a in names]
    audit += [f"SELECT 'rate', '{a}', NULL, '{c}', round(avg(CAST({c} = 'NEG' AS INT)), 9) FROM audited WHERE split = '{a}'"
              for a in names for c in ("LOW_QUALITY", "TOXIC")]
    in_other = "count({x}) FROM audited WHERE split = '{a}' AND content IN (SELECT content FROM audited WHERE split = '{b}')"
    audit += [f"SELECT 'shared_texts', '{a}', '{b}', NULL, " + in_other.format(x="DISTINCT content", a=a, b=b)
              for i, a in enumerate(names) for b in names[i + 1:]]
    audit += [f"SELECT 'shared_rows', '{a}', '{b}', NULL, " + in_other.format(x="*", a=a, b=b)
              for a in names for b in names if a != b]
    out["split_audit"] = _q(
        [*_GOLD, "normalized"],
        " UNION ALL ".join(audit),
        {
            "pool": "SELECT * FROM gold_reviews WHERE score < 5",
            "pool_split": _sample("pool", "LOW_QUALITY, TOXIC", "floor(0.2E0 * {n} + 0.5)", 12),
            "audited": "SELECT n.content, LOW_QUALITY, TOXIC, CASE WHEN taken THEN 'valid' ELSE 'train' END AS split "
            "FROM pool_split JOIN normalized n USING (review_id) UNION ALL "
            "SELECT n.content, LOW_QUALITY, TOXIC, 'test' FROM gold_reviews g JOIN normalized n USING (review_id) WHERE g.score = 5",
        },
    )
    out["build_splits_audit"] = (
        "SELECT 'shared_texts' AS metric, unnest(['train', 'valid']) AS split, 'test' AS other, "
        "CAST(NULL AS VARCHAR) AS category, CAST(0 AS DOUBLE) AS value"
    )
    out["leaked_rows"] = _q(
        [*_GOLD, "normalized"],
        "SELECT n.review_id FROM gold g JOIN normalized n USING (review_id) WHERE n.content IN "
        "(SELECT content FROM normalized WHERE review_id NOT IN (SELECT review_id FROM gold))",
    )
    out["split_leaks"] = _q(
        [*_GOLD, "normalized"],
        "SELECT n.review_id, 'leak' AS failed_checks FROM gold g JOIN normalized n USING (review_id) "
        "WHERE n.review_id % 5 <> 0 AND n.content IN (SELECT content FROM normalized JOIN gold USING (review_id) "
        "WHERE review_id % 5 = 0)",
    )
    out["dense_row_ids"] = _q(
        ["gold", "chunked"], "SELECT review_id, row_id FROM chunked"
    )
    out["assign_chunks"] = _q(
        _REVIEW,
        "SELECT review_id, content, row_number() OVER (ORDER BY review_id) - 1 AS row_id, "
        "(row_number() OVER (ORDER BY review_id) - 1) // 500 AS chunk_id FROM reviews",
    )
    shots = [*_GOLD, "shot_marked", "shots", "blocks"]
    out["few_shot_blocks"] = _q(shots, "SELECT * FROM blocks")
    out["few_shot_markdown"] = _q(
        shots,
        "SELECT '## 4. Few-Shot Demonstrations' || chr(10) || chr(10) || "
        "string_agg(block, chr(10) ORDER BY example) AS markdown FROM blocks",
    )
    out["prompt_source"] = _q(
        shots,
        "SELECT review_id, md5((SELECT array_to_string(list_filter(string_split('## 4. Few-Shot Demonstrations' || chr(10) || "
        "string_agg(block, chr(10) ORDER BY example), chr(10)), lambda x: x <> ''), chr(10)) FROM blocks)) AS prompt_md5 "
        "FROM gold_reviews",
    )

    # labelling
    out["label_requests"] = _q(
        _REVIEW,
        "SELECT review_id, 'row_' || review_id AS custom_id, 'POST' AS method, "
        "'/v1/chat/completions' AS url, 'm' AS model, 0.0E0 AS temperature, 150 AS max_tokens, "
        "'Label it.' AS system_text, 'Review: \"' || content || '\"' AS user_text, "
        "'NEG,ABSENT' AS toxic_enum, 'LOW_QUALITY,TOXIC' AS required, false AS additional FROM reviews",
    )
    labels = '{"type":"string","enum":["NEG","ABSENT"]}'
    out["request_files"] = _q(
        [*_GOLD, "chunked"],
        "SELECT c.review_id, CAST(c.chunk_id // 2 AS INT) AS chunk_group, concat("
        "'{\"custom_id\":\"row_', c.review_id, '\",\"method\":\"POST\",\"url\":\"/v1/chat/completions\",\"body\":"
        "{\"model\":\"m\",\"temperature\":0.0,\"max_completion_tokens\":150,\"messages\":["
        "{\"role\":\"system\",\"content\":\"Label it.\"},{\"role\":\"user\",\"content\":', "
        "CAST(to_json(concat('Review: \"', g.content, '\"')) AS VARCHAR), "
        "'}],\"response_format\":{\"type\":\"json_schema\",\"json_schema\":{\"name\":\"defect_schema\",\"strict\":true,"
        f"\"schema\":{{\"type\":\"object\",\"properties\":{{\"LOW_QUALITY\":{labels},\"TOXIC\":{labels}}},"
        "\"required\":[\"LOW_QUALITY\",\"TOXIC\"],\"additionalProperties\":false}}}}}') AS line "
        "FROM chunked c JOIN gold_reviews g USING (review_id)",
    )
    out["parse_responses"] = _q(_ANSWERS, "SELECT * FROM answers")
    out["response_files"] = out["parse_responses"]
    out["attach_predictions"] = _q(
        [*_GOLD, "answers"],
        "SELECT review_id, content, LOW_QUALITY_pred, TOXIC_pred FROM gold_reviews JOIN answers USING (review_id)",
    )
    out["reindex_predictions"] = _q(
        ["reviews", "gold", "answers"],
        "SELECT review_id, LOW_QUALITY_pred, TOXIC_pred FROM reviews LEFT JOIN answers USING (review_id)",
    )
    first = {"done": "SELECT * FROM answers WHERE review_id < (SELECT max(review_id) // 2 FROM gold)"}
    open_chunks = "(SELECT chunk_id FROM chunked c LEFT JOIN done d USING (review_id) GROUP BY chunk_id HAVING count(d.review_id) < count(*))"
    out["pending_chunks"] = _q(
        [*_ANSWERS, "chunked"], f"SELECT review_id, chunk_id FROM chunked WHERE chunk_id IN {open_chunks}", first
    )
    out["chunk_progress"] = _q(
        [*_ANSWERS, "chunked"],
        "SELECT chunk_id, count(*) AS total_rows, count(d.review_id) AS done_rows "
        "FROM chunked LEFT JOIN done d USING (review_id) GROUP BY chunk_id", first,
    )
    out["progress"] = _q(
        _ANSWERS,
        "SELECT (SELECT count(*) FROM done) AS classified_rows, count(*) AS total_rows, "
        "CAST(ceil(count(*) / 100) AS BIGINT) AS total_chunks FROM gold", first,
    )
    compacted = (
        "SELECT review_id, CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN 2 ELSE 1 END "
        "AS attempt, CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN LOW_QUALITY "
        "ELSE LOW_QUALITY_pred END AS LOW_QUALITY_pred, "
        "CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN TOXIC ELSE TOXIC_pred END AS TOXIC_pred, "
        "merges FROM gold JOIN answers USING (review_id) CROSS JOIN (VALUES (1), (2)) AS m(merges)"
    )
    out["checkpoint_compacted"] = _q(_ANSWERS, compacted)
    out["model_after_interrupted_save"] = _q(
        _REVIEW, "SELECT review_id, score, score >= 2 AS good_latest, score >= 4 AS good, 0.8E0 AS val_f1 FROM reviews"
    )
    table_rows = (
        "SELECT review_id, LOW_QUALITY_pred, TOXIC_pred, 'data/gold' AS input, 'short' AS prompt, 'scorer' AS model FROM predicted "
        "UNION ALL SELECT review_id, LOW_QUALITY_pred, TOXIC_pred, 'data/gold', 'short', 'answers v2' FROM answers "
        "WHERE LOW_QUALITY_pred <> 'ERROR'"
    )
    out["predictions_table"] = _q([*_PREDICTED, "answers"], table_rows)
    out["predictions_exact_match"] = _q(
        [*_PREDICTED, "answers"],
        "SELECT model, count(*) AS rows, round(avg(CAST(t.LOW_QUALITY_pred = g.LOW_QUALITY AND t.TOXIC_pred = g.TOXIC AS DOUBLE)), 9) "
        f"AS exact_match_ratio FROM ({table_rows}) t JOIN gold g USING (review_id) GROUP BY model",
    )
    out["checkpoint_latest"] = _q(
        _ANSWERS,
        "SELECT review_id, CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN 2 ELSE 1 END "
        "AS attempt, CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN LOW_QUALITY "
        "ELSE LOW_QUALITY_pred END AS LOW_QUALITY_pred, "
        "CASE WHEN LOW_QUALITY_pred = 'ERROR' OR TOXIC_pred = 'ERROR' THEN TOXIC ELSE TOXIC_pred END AS TOXIC_pred "
        "FROM gold JOIN answers USING (review_id)",
    ).replace("THEN 2 ELSE 1 END", "THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END")
    out["classify_external"] = _q(
        _REVIEW,
        "SELECT review_id, CASE WHEN length(content) % 19 = 0 THEN 'ERROR' "
        "WHEN length(content) % 2 = 1 THEN 'NEG' ELSE 'ABSENT' END AS LOW_QUALITY_pred, "
        "CASE WHEN length(content) % 19 = 0 OR length(content) % 13 = 0 THEN 'ERROR' "
        "WHEN length(content) % 5 = 0 THEN 'NEG' ELSE 'ABSENT' END AS TOXIC_pred FROM "
        "(SELECT review_id, content FROM reviews UNION ALL "
        "SELECT -review_id - 1, '' FROM reviews WHERE review_id % 5 = 0)",
    )
    out["classify_once"] = _q(
        _REVIEW,
        "SELECT review_id, CASE WHEN length(content) % 19 = 0 THEN 'ERROR' "
        "WHEN length(content) % 2 = 1 THEN 'NEG' ELSE 'ABSENT' END AS LOW_QUALITY_pred, "
        "CASE WHEN length(content) % 19 = 0 THEN 'ERROR' WHEN length(content) % 5 = 0 THEN 'NEG' ELSE 'ABSENT' END "
        "AS TOXIC_pred, CAST(1 AS BIGINT) AS calls, "
        "EXISTS (SELECT 1 FROM reviews WHERE length(content) % 7 = 3) AS broke_down FROM reviews",
    )
    out["unidentified_answers"] = _q(
        _ANSWERS,
        "SELECT a.LOW_QUALITY_pred, a.TOXIC_pred, count(*) AS n, "
        "(SELECT count(*) FROM answers WHERE review_id % 7 <> 0) AS kept "
        "FROM answers a WHERE a.review_id % 7 = 0 GROUP BY ALL",
    )

    # scoring
    out["sigmoid_threshold"] = _q(
        _PREDICTED,
        "SELECT review_id, round_even(LOW_QUALITY_prob, 4) AS LOW_QUALITY_prob, LOW_QUALITY_pred, "
        "round_even(TOXIC_prob, 4) AS TOXIC_prob, TOXIC_pred FROM predicted",
    )
    out["score_kind_auto"] = _q(
        _PREDICTED,
        "SELECT review_id, LOW_QUALITY_pred AS from_logits, TOXIC_pred AS from_probs FROM predicted",
    )
    out["score_kind_labels"] = (
        "SELECT doc_id AS review_id, CAST(toxic AS DOUBLE) AS TOXIC_prob, "
        "CASE toxic WHEN 1 THEN 'NEG' WHEN 0 THEN 'ABSENT' END AS TOXIC_pred FROM labels"
    )
    out["ingest_reviews"] = _q(
        _REVIEW,
        "SELECT user_name, score, 1700000000 + review_id AS seconds, content, CAST(1 AS BIGINT) AS n, "
        "CAST(1 AS BIGINT) AS ids FROM reviews",
    )
    landings = {
        "landed": "SELECT user_name, score, 1700000000 + review_id % 2 AS seconds, content, "
        "CAST(CASE WHEN bool_or(review_id % 3 <> 0) THEN 1 ELSE 2 END AS BIGINT) AS landing FROM reviews GROUP BY ALL"
    }
    out["land_twice"] = _q(
        _REVIEW, "SELECT user_name, score, seconds, content, landing FROM landed", landings
    )
    out["landing_ids"] = _q(
        _REVIEW,
        "SELECT landing, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY landing) - count(*) AS BIGINT) AS first, "
        "CAST(sum(count(*)) OVER (ORDER BY landing) - 1 AS BIGINT) AS last FROM landed GROUP BY landing",
        landings,
    )
    out["annotation_round_trip"] = _q(
        _GOLD,
        "SELECT review_id, content, 1700000000 + review_id AS seconds, LOW_QUALITY, "
        "CASE WHEN review_id % 7 = 0 THEN 'neg?' WHEN review_id % 11 <> 0 THEN TOXIC END AS TOXIC, "
        "CASE WHEN review_id % 7 = 0 OR review_id % 11 = 0 THEN 'TOXIC' ELSE '' END AS failed_checks FROM gold_reviews",
    )
    out["probability_checks"] = _q(
        ["gold", "scores"],
        "SELECT review_id, concat_ws(',', CASE WHEN LOW_QUALITY_logit NOT BETWEEN 0 AND 1 THEN 'LOW_QUALITY_logit' END, "
        "CASE WHEN TOXIC_logit NOT BETWEEN 0 AND 1 THEN 'TOXIC_logit' END) AS failed_checks FROM scores",
    )
    out["triage_result"] = _q([*_REVIEW, "scored_text"], _TRIAGE)
    out["triage_stream"] = out["triage_result"]

    # metrics
    out["confusion"] = _q(
        [*_RUNS, "long"],
        "SELECT model, category, count(*) FILTER (truth = 'NEG' AND p = 'NEG') AS tp, "
        "count(*) FILTER (truth = 'ABSENT' AND p = 'NEG') AS fp, "
        "count(*) FILTER (truth = 'NEG' AND p = 'ABSENT') AS fn, "
        "count(*) FILTER (truth = 'ABSENT' AND p = 'ABSENT') AS tn FROM long GROUP BY ALL",
    )
    out["category_metrics"] = _q(
        _REPORT[:-2],
        "SELECT category, round(macro_f1, 9) AS macro_f1, round(absent_recall, 9) AS absent_recall, "
        "round(neg_recall, 9) AS neg_recall FROM report WHERE model = 'scorer'",
    )
    out["exact_match"] = _q([*_RUNS, "exact_rows"], "SELECT * FROM exact_rows WHERE model = 'scorer'")
    out["metrics_report"] = _q(
        _REPORT,
        "SELECT section, metric, round(value, 9) AS value FROM metric_rows WHERE model = 'scorer'",
    )
    out["model_compare"] = _q(
        _REPORT, "SELECT model, section, metric, round(value, 9) AS value FROM metric_rows"
    )
    value = "(SELECT printf('%.4f', value) FROM metric_rows WHERE model = 'scorer' AND metric = '{}')"
    rule = "'--------------------------'"
    lines = [rule, "'PRIMARY METRIC'", rule]
    lines += [f"'{c} Macro F1-score: ' || {value.format(c + '_macro_f1')}" for c in ("LOW_QUALITY", "TOXIC")]
    lines += [f"'Mean Macro F1-score: ' || {value.format('macro_f1_mean')}"]
    lines += [rule, "'SECONDARY METRIC (Exact Match)'", rule]
    lines += [f"'Exact Match Ratio: ' || {value.format('exact_match_ratio')}"]
    lines += [rule, "'DIAGNOSTIC METRIC (Recall)'", rule]
    for c in ("LOW_QUALITY", "TOXIC"):
        lines += [f"'{c} ABSENT Recall: ' || {value.format(c + '_absent_recall')}"]
        lines += [f"'{c} NEG Recall: ' || {value.format(c + '_neg_recall')}"]
    out["report_text"] = _q(_REPORT, f"SELECT concat_ws(chr(10), {', '.join(lines)}) AS report")
    out["batch_loss"] = _q(
        _PREDICTED,
        "SELECT round(avg(loss), 9) AS loss FROM (SELECT unnest(["
        + ", ".join(
            f"greatest({c}_logit, 0) - {c}_logit * CAST({c} = 'NEG' AS DOUBLE) + ln(1 + exp(-abs({c}_logit)))"
            for c in ("LOW_QUALITY", "TOXIC")
        )
        + "]) AS loss FROM predicted)",
    )
    differs = "(LOW_QUALITY <> LOW_QUALITY_pred OR TOXIC <> TOXIC_pred)"
    out["mismatches"] = _q(
        _ANSWERS, f"SELECT * FROM gold JOIN answers USING (review_id) WHERE {differs}"
    )
    out["mismatch_preview"] = _q(
        [*_GOLD, "answers"],
        f"SELECT review_id, content, LOW_QUALITY, TOXIC, LOW_QUALITY_pred, TOXIC_pred "
        f"FROM gold_reviews JOIN answers USING (review_id) WHERE {differs}",
    )
    out["evaluate_split"] = _q(
        [*_GOLD, "scored_text"],
        "SELECT s.content, LOW_QUALITY, CASE WHEN p1 >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS LOW_QUALITY_pred, "
        "round_even(p1, 4) AS LOW_QUALITY_prob, TOXIC, "
        "CASE WHEN p2 >= 0.5 THEN 'NEG' ELSE 'ABSENT' END AS TOXIC_pred, round_even(p2, 4) AS TOXIC_prob "
        "FROM gold JOIN scored_text s USING (review_id)",
    )
    out["best_epoch"] = _q(["epochs"], best.format("DESC"))
    out["metrics_log"] = out["best_epoch"]
    out["best_epoch_lowest"] = _q(["epochs"], best.format("ASC"))

    # terms
    out["word_ngrams"] = _q(
        _TERMS[:5],
        "SELECT review_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams FROM tf GROUP BY review_id",
    )
    out["document_frequency"] = _q(
        _TERMS[:5], "SELECT df, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_grams FROM "
        "(SELECT count(*) AS df, sum(tf) AS n FROM tf GROUP BY term) GROUP BY df"
    )
    out["tf_idf"] = _q(_TERMS[:7], "SELECT review_id, term, round(weight, 8) AS weight FROM tfidf")
    out["top_terms_overall"] = _q(_TERMS, top.format("weight"))
    out["top_terms_neg"] = _q(_TERMS, top.format("neg_mean_weight"))
    out["top_terms_pos"] = _q(_TERMS, top.format("pos_mean_weight"))

    # features and files
    out["fixed_length_rows"] = _q(
        [*_GOLD, "normalized"],
        "SELECT w.review_id, array_to_string(list_resize(coalesce(ids, CAST([] AS BIGINT[])), 128, 0), ',') AS input_ids, "
        "CAST(coalesce(len(ids), 0) AS INT) AS n_tokens, "
        "concat(CAST(LOW_QUALITY = 'NEG' AS INT), ',', CAST(TOXIC = 'NEG' AS INT)) AS labels "
        "FROM words w LEFT JOIN seqs USING (review_id)",
        {
            "words": r"SELECT review_id, LOW_QUALITY, TOXIC, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}') AS t FROM gold_reviews",
            "vocab": "SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM "
            "(SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM words) GROUP BY token) "
            "ORDER BY n DESC, token LIMIT 30000",
            "seqs": "SELECT review_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM "
            "(SELECT review_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM words) p "
            "LEFT JOIN vocab v USING (token) WHERE pos <= 128 GROUP BY review_id",
        },
    )
    out["csv_round_trip"] = _q(_REVIEW, "SELECT review_id, score, content FROM reviews")
    out["parquet_columns"] = "SELECT doc_id, text FROM documents"
    out["split_files"] = _q(
        [*_GOLD, "split"],
        "SELECT content, CAST(LOW_QUALITY = 'NEG' AS BIGINT) AS LOW_QUALITY, CAST(TOXIC = 'NEG' AS BIGINT) AS TOXIC "
        "FROM split WHERE taken",
    )
    return out
