"""The same questions in DuckDB's SQL, put to the same tables.

Nothing here imports the library's operators: profiles are written as plain SQL with
DuckDB's own quantiles, moments and windows.
"""

from __future__ import annotations

from tabassay.functions import fixed_values as fv

SPACES = " || ".join(f"chr({ord(c)})" for c in fv.WHITE_SPACE)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"trim({c}, {SPACES})"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def number(c: str) -> str:
    """Text as a number, by the numeric grammar."""
    s = trim(c)
    value = f"TRY_CAST({s} AS DOUBLE)"
    return (
        f"(CASE WHEN {matches(s, fv.FINITE_NUMBER)} THEN"
        f" (CASE WHEN isinf({value}) THEN NULL ELSE {value} END)"
        f" WHEN {matches(s, fv.INFINITE_NUMBER)} THEN {value} END)"
    )


def normal(c: str) -> str:
    tokens = ", ".join(lit(t) for t in fv.NA_TOKENS)
    return f"(CASE WHEN {trim(c)} NOT IN ({tokens}) THEN {trim(c)} END)"


def empty(c: str, kind: str = "text") -> str:
    if kind != "text":
        return f"({c} IS NULL)"
    return f"({c} IS NULL OR {trim(c)} = '' OR lower({trim(c)}) = 'nan')"


def shape(c: str) -> str:
    whens = " ".join(f"WHEN {matches(trim(c), p)} THEN {lit(n)}" for n, p in fv.DATE_SHAPES)
    return f"(CASE {whens} END)"


def email_fault(c: str) -> str:
    s = trim(c)
    domain = f"string_split({s}, '@')[2]"
    return (
        f"(CASE WHEN {c} IS NULL THEN NULL WHEN strpos({s}, '@') = 0 THEN 'missing @'"
        f" WHEN len(string_split({s}, '@')) <> 2 THEN 'multiple @ symbols'"
        f" WHEN string_split({s}, '@')[1] = '' THEN 'empty local part'"
        f" WHEN strpos({domain}, '.') = 0 THEN 'domain has no dot'"
        f" WHEN {domain} LIKE '%..%' OR {domain} LIKE '.%' OR {domain} LIKE '%.'"
        f" THEN 'invalid domain' ELSE '' END)"
    )


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN 100.0 * {part} / {whole} ELSE 0 END)"


def level(score: str) -> str:
    return (
        f"(CASE WHEN {score} >= 90 THEN 'Excellent' WHEN {score} >= 70 THEN 'Good'"
        f" WHEN {score} >= 50 THEN 'Needs Cleaning' ELSE 'Poor' END)"
    )


def profile(source: str, columns: dict[str, str], *, segment: str = "", id_heuristic=True,
            heads: str = "") -> str:
    """CTEs src, u, ..., prof.  ``columns`` maps a name to text, whole, real or other.

    ``heads`` is a row order for the prefix heuristics; without it the dates and e-mails are
    looked for in the distinct values with the smallest MD5.
    """
    seg = f"{segment} AS seg" if segment else "0 AS seg"
    rows = []
    for i, (c, kind) in enumerate(columns.items()):
        num = {"text": number(c), "other": "CAST(NULL AS DOUBLE)"}.get(kind, f"CAST({c} AS DOUBLE)")
        key = heads or "0"
        rows.append(
            f"SELECT {seg}, {i} AS ordinal, '{c}' AS col, '{kind}' AS kind,"
            f" CAST({c} AS VARCHAR) AS v, {num} AS num, {key} AS k FROM src"
        )
    is_text = "kind = 'text'"
    code = matches(trim("v"), fv.LETTER_AND_DIGIT)
    head = (
        f"""heads AS (SELECT seg, col,
            count(DISTINCT {shape('v')}) AS shapes,
            coalesce(bool_or(rn <= 10 AND strpos(v, '@') > 0), false) AS has_at,
            count(*) FILTER (WHERE rn <= 50 AND {code}) AS code_like,
            count(*) FILTER (WHERE rn <= 50) AS code_base
          FROM (SELECT *, row_number() OVER (PARTITION BY seg, col ORDER BY k, v) AS rn
                FROM u WHERE v IS NOT NULL) WHERE rn <= 100 GROUP BY seg, col),"""
        if heads
        else f"""heads AS (SELECT seg, col,
            count(DISTINCT {shape('v')}) FILTER (WHERE rn <= 100 OR NOT {is_text}) AS shapes,
            coalesce(bool_or(rn <= 10 AND strpos(v, '@') > 0), false) AS has_at,
            count(*) FILTER (WHERE {code}) AS code_like, count(*) AS code_base
          FROM (SELECT *, dense_rank() OVER (PARTITION BY seg, col ORDER BY md5(v)) AS rn
                FROM u WHERE v IS NOT NULL) GROUP BY seg, col),"""
    )
    identifier = (
        "uniq * 1.0 / total > 0.65 AND uniq > 50"
        " AND (code_like * 1.0 / greatest(code_base, 1) > 0.2 OR uniq * 1.0 / total > 0.7)"
        if id_heuristic
        else "false"
    )
    return f"""
    WITH src AS ({source}),
    u AS ({' UNION ALL '.join(rows)}),
    {head}
    counts AS (SELECT seg, ordinal, col, kind, count(*) AS total, count(v) AS filled,
        count(*) - count(v) AS nulls, count(DISTINCT v) AS uniq, count(num) AS parsed,
        count(*) FILTER (WHERE num < 0) AS negatives,
        count(*) FILTER (WHERE {matches(trim('v'), fv.FLOAT_LITERAL)}) AS numlike,
        count(*) FILTER (WHERE {is_text} AND v <> {trim('v')}) AS spaced,
        count(*) FILTER (WHERE {is_text} AND {matches('v', '|'.join(fv.MOJIBAKE))}) AS moji,
        count(*) FILTER (WHERE {email_fault('v')} <> '') AS bad_email,
        avg(num) AS mean, stddev_samp(num) AS std, min(num) AS mn, max(num) AS mx,
        quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS q2, quantile_cont(num, 0.75) AS q3
      FROM u GROUP BY seg, ordinal, col, kind),
    beyond AS (SELECT u.seg, u.col,
        count(*) FILTER (WHERE num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1)) AS outliers,
        count(*) FILTER (WHERE num < q1 - 5 * (q3 - q1) OR num > q3 + 5 * (q3 - q1)) AS extremes
      FROM u JOIN counts c ON u.seg IS NOT DISTINCT FROM c.seg AND u.col = c.col GROUP BY u.seg, u.col),
    typed AS (SELECT counts.*, coalesce(shapes, 0) AS shapes, coalesce(has_at, false) AS has_at,
        outliers, extremes,
        CASE WHEN {identifier.replace('code_like', 'coalesce(code_like, 0)').replace('code_base', 'coalesce(code_base, 0)')} THEN 'categorical'
             WHEN total - parsed - nulls > 0.3 * total THEN 'categorical'
             WHEN total - parsed < 0.3 * total THEN 'numeric' ELSE 'categorical' END AS dtype
      FROM counts LEFT JOIN heads USING (seg, col) JOIN beyond USING (seg, col)),
    prof AS (SELECT seg, ordinal, col AS "column", dtype, total AS total_count,
        nulls AS null_count, {pct('nulls', 'total')} AS null_pct, uniq AS unique_count,
        uniq * 1.0 / total AS cardinality, parsed AS parsed_count,
        CASE WHEN dtype = 'numeric' THEN mean END AS mean,
        CASE WHEN dtype = 'numeric' THEN CASE WHEN parsed = 1 THEN 0 ELSE std END END AS std,
        CASE WHEN dtype = 'numeric' THEN mn END AS min_val,
        CASE WHEN dtype = 'numeric' THEN q1 END AS q1,
        CASE WHEN dtype = 'numeric' THEN q2 END AS median,
        CASE WHEN dtype = 'numeric' THEN q3 END AS q3,
        CASE WHEN dtype = 'numeric' THEN mx END AS max_val,
        CASE WHEN dtype = 'numeric' THEN outliers ELSE 0 END AS outlier_count,
        CASE WHEN dtype = 'numeric' THEN {pct('outliers', 'parsed')} ELSE 0 END AS outlier_pct,
        CASE WHEN dtype = 'numeric' THEN extremes ELSE 0 END AS extreme_outlier_count,
        CASE WHEN dtype = 'numeric' THEN negatives ELSE 0 END AS negative_count,
        CASE WHEN dtype = 'numeric' THEN {pct('negatives', 'parsed')} ELSE 0 END AS negative_pct,
        CASE WHEN dtype = 'numeric' THEN 0 ELSE shapes END AS date_format_count,
        CASE WHEN dtype = 'numeric' THEN 0 ELSE spaced END AS whitespace_count,
        CASE WHEN dtype = 'numeric' THEN 0 ELSE {pct('spaced', 'filled')} END AS whitespace_pct,
        CASE WHEN dtype = 'numeric' THEN 0 ELSE moji END AS encoding_issues,
        CASE WHEN dtype = 'categorical' AND (lower(col) LIKE '%email%' OR has_at)
             THEN bad_email ELSE 0 END AS invalid_email_count,
        CASE WHEN dtype = 'categorical' AND (lower(col) LIKE '%email%' OR has_at)
             THEN {pct('bad_email', 'filled')} ELSE 0 END AS invalid_email_pct,
        CASE WHEN dtype = 'numeric' THEN {pct('(filled - parsed)', 'total')}
             WHEN numlike > 0 AND numlike < filled THEN (1 - numlike * 1.0 / filled) * 100
             ELSE 0 END AS mixed_type_pct
      FROM typed)
    """


TOP = """, ranked AS (SELECT seg, col, v, count(*) AS n,
        row_number() OVER (PARTITION BY seg, col ORDER BY count(*) DESC, v) AS place
      FROM u WHERE v IS NOT NULL GROUP BY seg, col, v),
    top AS (SELECT ordinal, "column", place, v AS value, n FROM ranked
      JOIN prof ON ranked.col = prof."column" WHERE place <= 5 AND dtype = 'categorical')
"""

LOW = "(dtype = 'numeric' AND cardinality < 0.05 AND unique_count < 20)"


def one(x: str) -> str:
    return f"format('{{:.1f}}', round({x}, 1))"


_COL = "'Column `' || \"column\" || '`"
_SIGNED = " OR ".join(f"lower(\"column\") LIKE '%{p}%'" for p in fv.SIGNED_NAME_PARTS)

# condition, points lost, issue, advice
FINDINGS = [
    ("null_pct > 0", "least(null_pct * 1.2, 30)", f"{one('null_pct')} || '% null values'",
     f"{_COL} is ' || {one('null_pct')} || '% null — ' || CASE WHEN null_pct > 60 THEN"
     " 'consider dropping' ELSE 'impute with ' || CASE WHEN dtype = 'numeric' THEN 'median'"
     " ELSE 'mode' END END"),
    ("mixed_type_pct > 5", "least(mixed_type_pct * 0.8, 20)",
     f"{one('mixed_type_pct')} || '% non-numeric values in otherwise numeric column'",
     f"{_COL} has mixed types — investigate non-numeric entries like ''TBD'', ''N/A'''"),
    ("dtype = 'numeric' AND outlier_pct > 0", "least(outlier_pct, 25)",
     f"{one('outlier_pct')} || '% outliers (IQR method)'",
     f"{_COL} has ' || {one('outlier_pct')} || '% outliers — review for data entry errors'"),
    ("extreme_outlier_count > 0", "least(extreme_outlier_count * 3, 20)",
     "extreme_outlier_count || ' extreme outlier(s) (5× IQR)'",
     f"{_COL} has ' || extreme_outlier_count || ' extreme outlier(s) — likely data entry errors'"),
    (f"negative_count > 0 AND NOT ({_SIGNED})", "least(negative_pct * 1.5, 15)",
     f"negative_count || ' negative value(s) (' || {one('negative_pct')} || '%)'",
     f"{_COL} has negative values — validate with source system'"),
    (LOW, "10", "'Low cardinality numeric (likely categorical)'",
     f"{_COL} has only ' || unique_count || ' unique values — consider treating as categorical'"),
    ("date_format_count >= 2", "15", "date_format_count || ' different date formats detected'",
     f"{_COL} has mixed date formats — standardize to ISO 8601'"),
    ("date_format_count >= 1 AND dtype = 'categorical' AND mixed_type_pct < 50", "10",
     "CASE WHEN date_format_count = 1 THEN 'Likely date column parsed as string' END",
     f"{_COL} appears to contain dates — cast to DATE type'"),
    ("invalid_email_count > 0", "least(invalid_email_pct * 0.8, 15)",
     "invalid_email_count || ' invalid email(s)'",
     f"{_COL} has ' || invalid_email_count || ' malformed emails — validate input'"),
    ("whitespace_count > 0", "least(whitespace_pct * 0.5, 10)",
     "whitespace_count || ' value(s) with leading/trailing whitespace'",
     f"{_COL} has whitespace issues — use .str.strip()'"),
    ("encoding_issues > 0", "10",
     "encoding_issues || ' value(s) with encoding corruption (mojibake)'",
     f"{_COL} has encoding issues — re-import in UTF-8'"),
]


def _joined(i: int) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {f[0]} THEN {f[i]} END" for f in FINDINGS) + ")"


SCORED = f""", points AS (SELECT *, greatest(0, least(100, 100.0
        - {' - '.join(f'(CASE WHEN {f[0]} THEN {f[1]} ELSE 0 END)' for f in FINDINGS)})) AS quality_score
      FROM prof),
    scored AS (SELECT *, {level('quality_score')} AS quality_level,
        {_joined(2)} AS issues, {_joined(3)} AS recommendations FROM points)
"""


def duplicates(columns: list[str], segment: str = "") -> str:
    """CTE dup: rows, repeats and their share, per segment."""
    names = ", ".join(columns)
    seg = segment or "0"
    return f""", dup AS (SELECT seg, sum(n) AS total_rows, sum(n - 1) AS duplicate_rows,
        {pct('sum(n - 1)', 'sum(n)')} AS duplicate_pct
      FROM (SELECT {seg} AS seg, count(*) AS n FROM src GROUP BY {names}) GROUP BY seg)
    """


TABLE = f""", pen AS (SELECT scored.seg, 0.25 * avg(null_pct) AS nulls,
        min(least(2 * duplicate_pct, 20)) AS duplicates,
        coalesce(0.2 * avg(outlier_pct) FILTER (WHERE dtype = 'numeric'), 0) AS outliers,
        15.0 * avg(CASE WHEN mixed_type_pct > 5 THEN 1 ELSE 0 END) AS type_mismatch,
        10.0 * avg(CASE WHEN {LOW} THEN 1 ELSE 0 END) AS low_cardinality,
        10.0 * (count(*) FILTER (WHERE date_format_count >= 2)
          + count(*) FILTER (WHERE invalid_email_count > 0)
          + count(*) FILTER (WHERE encoding_issues > 0)) / count(*) AS deep_issues
      FROM scored JOIN dup ON scored.seg IS NOT DISTINCT FROM dup.seg GROUP BY scored.seg),
    tab AS (SELECT *, greatest(0, 100 - (nulls + duplicates + outliers + type_mismatch
        + low_cardinality + deep_issues)) AS overall FROM pen)
"""


def dimensions(found: dict[str, str], *, date: str = "", as_of: str = "", email: str = "",
               label: str = "") -> str:
    """CTE dim.  ``found`` maps the required columns to their kinds."""
    focus = f"\"column\" IN ({', '.join(lit(c) for c in found)})" if found else "true"
    viol = " + ".join(f"CASE WHEN {empty(c, k)} THEN 1 ELSE 0 END" for c, k in found.items()) or "0"
    validity = (
        f"(SELECT 100 - 100.0 * sum({viol}) / (count(*) * {len(found)}) FROM src)" if found else "100"
    )
    time = (
        f"""(SELECT greatest(0, 100 - least(date_diff('day', max(coalesce(
              try_strptime({date}, '%Y-%m-%d'), try_strptime({date}, '%m/%d/%Y'))),
              TIMESTAMP {lit(as_of)}) / 3.65, 100)) FROM src)"""
        if date
        else "100"
    )
    mail = (
        f"(SELECT 100 - 100.0 * invalid_email_count / (total_count - null_count) FROM prof"
        f" WHERE \"column\" = {lit(email)})"
        if email
        else validity
    )
    named = f"(SELECT 100 - null_pct FROM prof WHERE \"column\" = {lit(label)})" if label else "100"
    deep = "date_format_count >= 2 OR invalid_email_count > 0 OR encoding_issues > 0"
    return f""", dim AS (SELECT
        round(100 - avg(null_pct) FILTER (WHERE {focus}), 2) AS completeness,
        round(100 - least(2 * (SELECT duplicate_pct FROM dup), 100), 2) AS uniqueness,
        round(100 - coalesce(avg(outlier_pct) FILTER (WHERE dtype = 'numeric'), 0), 2) AS outliers,
        round(100 - 100.0 * avg(CASE WHEN mixed_type_pct > 5 THEN 1 ELSE 0 END), 2) AS type_consistency,
        round(100 - 100.0 * avg(CASE WHEN {LOW} THEN 1 ELSE 0 END), 2) AS cardinality,
        round(100 - 100.0 * avg(CASE WHEN {deep} THEN 1 ELSE 0 END), 2) AS deep_checks,
        round({validity}, 2) AS validity, round({time}, 2) AS timeliness,
        round(greatest(0, 100 - least(500.0 * coalesce(sum(extreme_outlier_count), 0)
          / max(total_count), 100)), 2) AS "precision",
        round({mail}, 2) AS compliance, round({named}, 2) AS label_quality
      FROM prof)
    """


def weights(profile_id: str) -> list[tuple[int, str, float]]:
    items = fv.SECTOR_PROFILES[profile_id]["weights"].items()
    return [(i, d, w) for i, (d, w) in enumerate(items)]


def contributions(profile_id: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{d}' AS dimension, \"{d}\" AS score, CAST({w} AS DOUBLE) AS weight FROM dim"
        for i, d, w in weights(profile_id)
    )
    return f", contrib AS (SELECT *, round(score * weight, 2) AS weighted_contribution FROM ({rows}))"


def rules(specs: list[tuple]) -> str:
    """CTE rule.  A spec: id, name, severity, type, violations, checked, failed, passed texts.

    Violations and checked are scalar SQL over src.
    """
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, {lit(rid)} AS rule_id, {lit(name)} AS name, '{sev}' AS severity,"
        f" '{kind}' AS rule_type, CAST(({viol}) AS BIGINT) AS violation_count,"
        f" CAST(({checked}) AS BIGINT) AS total_checked, {lit(bad)} AS bad, {lit(good)} AS good"
        for i, (rid, name, sev, kind, viol, checked, bad, good) in enumerate(specs)
    )
    return f""", rule AS (SELECT ordinal, rule_id, name, severity, rule_type,
        violation_count = 0 AS passed, violation_count,
        round(100.0 * violation_count / greatest(total_checked, 1), 2) AS violation_pct, total_checked,
        CASE WHEN violation_count > 0 THEN violation_count || bad ELSE good END AS message
      FROM ({rows}))
    """


def repeats(columns: list[str], *, members: bool) -> str:
    extra = "CASE WHEN n > 1 THEN n ELSE 0 END" if members else "n - 1"
    return f"SELECT sum({extra}) FROM (SELECT count(*) AS n FROM src GROUP BY {', '.join(columns)})"


def count_where(condition: str) -> str:
    return f"SELECT count(*) FROM src WHERE {condition}"
