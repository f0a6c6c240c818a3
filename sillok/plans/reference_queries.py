"""Queries of the core operators over whole tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillok.functions import dates, text, urls
from sillok.operators import acquire, catalog, merge, scoring
from sillok.session import table
from sillok.sources import listings, robots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The moment all deadline states refer to: 2026-04-01 00:00 UTC.
NOW = 1_775_001_600
PROFILE = {"target_roles": ["데이터 엔지니어", "Backend Engineer"], "keywords": ["Python", "Kafka", "SQL", "Go"], "preferred_locations": ["부산", "세종"]}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TRACKED = "('" + "','".join(urls.TRACKERS) + "')"
#: Canonical address in SQL, for the http(s) shapes without user info that the table holds.
CANONICAL = f"""
SELECT * EXCLUDE (id, url, scheme, host, path, query, kept), id AS stored,
  scheme || '://' || lower(regexp_replace(host, ':(80|443)$', '')) || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN coalesce(array_to_string(kept, '&'), '') <> '' THEN '?' || array_to_string(kept, '&') ELSE '' END AS url
FROM (
  SELECT *, CASE WHEN query = '' THEN [] ELSE list_filter(string_split(query, '&'), lambda p:
      NOT (starts_with(lower(url_decode(string_split(p, '=')[1])), 'utm_') OR lower(url_decode(string_split(p, '=')[1])) IN {_TRACKED})) END AS kept
  FROM (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host,
      regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM job WHERE url IS NOT NULL AND url <> ''))
"""


@query(f"SELECT ordinal, url, sha256(url) AS id FROM ({CANONICAL})")
def q_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.observed(table(spark, sf_dir, "job").select("ordinal", "url")).select("ordinal", "url", "id")


@query(f"SELECT url, min(ordinal) AS ordinal FROM ({CANONICAL}) GROUP BY url")
def q_dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_seen(table(spark, sf_dir, "job").select("ordinal", "url"))


@query(f"""
WITH r AS (SELECT *, coalesce(evidence.completeness = 'listing_card', false) AS card, coalesce(length(description), 0) > 0 AS told FROM ({CANONICAL})),
g AS (SELECT url, min(ordinal) AS first_ordinal, count(*) AS observations, count(DISTINCT source_id) AS sources, arg_min(card, ordinal) AS card,
  min(ordinal) FILTER (WHERE NOT card AND told) AS rich FROM r GROUP BY url)
SELECT url, CASE WHEN card AND rich IS NOT NULL THEN rich ELSE first_ordinal END AS ordinal, first_ordinal, observations, sources, (card AND rich IS NOT NULL) AS switched FROM g""")
def q_merge_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job").select("ordinal", "url", "source_id", "description", "evidence")
    return merge.winners(rows).select("url", "ordinal", "first_ordinal", "observations", "sources", "switched")


@query(f"SELECT url, source_id, evidence.kind AS kind, evidence.source_url AS source_url, evidence.fetched_at AS fetched_at, evidence.completeness AS completeness, collected_at, min(ordinal) AS first_ordinal FROM ({CANONICAL}) GROUP BY url, source_id, evidence, collected_at")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job").select("ordinal", "url", "source_id", "evidence", "collected_at")
    return merge.provenance(rows).select("url", "source_id", "evidence.*", "collected_at", "first_ordinal")


@query(f"""SELECT url, min(ordinal) AS ordinal, any_value(source_id) AS source_id, any_value(collected_at) AS collected_at FROM ({CANONICAL})
GROUP BY url, source_id, title, company, description, location, employment_type, experience, collected_at, deadline, deadline_raw, evidence, ext, batch_no""")
def q_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct observations of every address."""
    return merge.observations(table(spark, sf_dir, "job")).select("url", "ordinal", "source_id", "collected_at")


@query(f"""WITH c AS ({CANONICAL}), u AS (SELECT url, count(*) AS observations, arg_min(ordinal, ordinal) AS o FROM c GROUP BY url),
s AS (SELECT url, list(source_id ORDER BY o) AS source_ids FROM (SELECT url, source_id, min(ordinal) AS o FROM c WHERE source_id IS NOT NULL GROUP BY ALL) GROUP BY url) SELECT url, array_to_string(source_ids, ',') AS source_ids FROM u LEFT JOIN s USING (url)""")
def q_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every address in the order they were met."""
    rows = table(spark, sf_dir, "job").select("ordinal", "url", "source_id")
    met = merge.observed(rows).groupBy("url", "source_id").agg(F.min("ordinal").alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("source_id").isNotNull(), F.struct("o", "source_id")))), lambda x: x["source_id"])
    return met.groupBy("url").agg(listed.alias("l")).select("url", F.nullif(F.array_join("l", ","), F.lit("")).alias("source_ids"))


@query(f"""SELECT ordinal, CASE WHEN coalesce(stored, '') = '' THEN 'missing' ELSE 'differs' END AS state FROM ({CANONICAL}) WHERE coalesce(stored, '') = '' OR stored <> sha256(url)""")
def q_stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.stale_ids(table(spark, sf_dir, "job").select("ordinal", "id", "url"))


@query("""SELECT ordinal FROM job WHERE contains(lower(concat_ws(' ', coalesce(title,''), coalesce(company,''), coalesce(description,''), coalesce(location,''), coalesce(experience,''), coalesce(employment_type,''))), '엔지니어')
AND contains(lower(concat_ws(' ', coalesce(title,''), coalesce(company,''), coalesce(description,''), coalesce(location,''), coalesce(experience,''), coalesce(employment_type,''))), 'python')""")
def q_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job").filter(text.all_words("엔지니어 Python", "title", "company", "description", "location", "experience", "employment_type")).select("ordinal")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])java([^a-z0-9_]|$)')")
def q_bounded_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(text.contains_term(F.lower("text"), "Java")).select("doc_id")


def _sql_score() -> str:
    # composed text, ASCII case folded; the terms hold no letters whose folding differs
    hay = "lower(nfc_normalize(concat_ws(chr(10), coalesce(title,''), coalesce(company,''), coalesce(description,''), coalesce(location,''), coalesce(employment_type,''), coalesce(experience,''))))"
    place = "lower(nfc_normalize(coalesce(location,'')))"
    terms = []
    for kind, weight in scoring.WEIGHTS.items():
        for t in PROFILE[kind]:
            t, source = t.lower(), place if kind == "preferred_locations" else "regexp_replace(" + hay + ", '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')"
            left, right = ("(^|[^a-z0-9_])" if t[0].isascii() else ""), ("([^a-z0-9_]|$)" if t[-1].isascii() else "")
            terms.append(f"CASE WHEN regexp_matches({source}, '{left}{t}{right}') THEN {weight} ELSE 0 END")
    return " + ".join(terms)


@query(f"SELECT ordinal, {_sql_score()} AS score FROM job")
def q_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "job"), PROFILE, "ordinal").select("ordinal", "score")


@query(f"SELECT ordinal, {_sql_score()} AS score FROM job ORDER BY score DESC, ordinal LIMIT 5")
def q_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top(scoring.scored(table(spark, sf_dir, "job"), PROFILE, "ordinal").select("ordinal", "score"), "ordinal")


@query(f"SELECT ordinal, row_number() OVER (ORDER BY {_sql_score()} DESC, ordinal) AS rank FROM job")
def q_rank_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.scored(table(spark, sf_dir, "job"), PROFILE, "ordinal").select("ordinal", "score")
    return merge.numbered(rows, F.desc("score"), "ordinal").select("ordinal", F.col("rank").cast("long").alias("rank"))


EXCLUDING = PROFILE | {"excluded_keywords": ["인턴", "contract"], "experience_level": "경력"}
_HAY = "lower(nfc_normalize(concat_ws(chr(10), coalesce(title,''), coalesce(company,''), coalesce(description,''), coalesce(location,''), coalesce(employment_type,''), coalesce(experience,''))))"


@query(f"""WITH r AS (SELECT ordinal, {_sql_score()} + CASE WHEN contains(lower(coalesce(experience, '')), '경력') THEN 2 ELSE 0 END AS score,
  contains({_HAY}, '인턴') OR regexp_matches({_HAY}, '(^|[^a-z0-9_])contract([^a-z0-9_]|$)') AS excluded,
  CASE WHEN deadline IS NOT NULL AND epoch(try_cast(deadline AS DATE)) + 86400 - 32400 <= {NOW} THEN true ELSE false END AS expired FROM job)
SELECT ordinal, score, expired, NOT (expired OR excluded) AS eligible, row_number() OVER (ORDER BY (expired OR excluded), score DESC, ordinal) AS rank FROM r""")
def q_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting ranked: neither expired nor excluded first, by score."""
    rows = scoring.ranked(table(spark, sf_dir, "job"), EXCLUDING, "ordinal", NOW)
    return rows.select("ordinal", "score", "expired", "eligible", F.col("rank").cast("long").alias("rank"))


@query("""SELECT doc_id, length(t) AS codepoints, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS utf16, strlen(t) AS utf8,
length(replace(t, chr(10), '')) AS no_newlines FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)""")
def q_text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    modes = {"codepoints": ("codepoints", "lf"), "utf16": ("utf16", "lf"), "utf8": ("utf8-bytes", "lf"), "no_newlines": ("codepoints", "none")}
    return table(spark, sf_dir, "documents").select("doc_id", *[text.count_text(t, m, True, rule).alias(n) for n, (m, rule) in modes.items()])


@query()
def q_cp949_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_text(F.col("text"), "cp949-bytes").alias("bytes"))


_SPACES = "\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}\\x0b\\x1c-\\x1f"


@query(f"""SELECT doc_id, length(t) AS count, coalesce(length(t) > 600, false) AS over, coalesce(length(t) < 450.0, false) AS under, coalesce(regexp_matches(t, '(?i)\\b(TBD|TODO)\\b|\\[확인 필요[^\\]]*\\]|○○'), false) AS draft,
NOT coalesce(regexp_matches(t, '[^{_SPACES}]'), false) AS blank FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)""")
def q_check_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("c", text.check_answer(F.col("text"), 600))
    has = lambda a, v: F.array_contains(F.col(a), v)
    return rows.select("doc_id", F.col("c.count").alias("count"), has("c.errors", "over_limit").alias("over"), has("c.warnings", "under_min_fill").alias("under"), has("c.warnings", "draft_marker").alias("draft"), has("c.errors", "blank").alias("blank"))


@query()
def q_cp949_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_text(F.col("text"), "cp949-bytes").alias("bytes"))


#: The strict reading in SQL: three date shapes, a clock with or without offset or in Korean; Seoul where none is stated.
STRICT = r"""
SELECT ordinal, raw, day, CASE WHEN clock = '' THEN NULL WHEN h < 24 AND mi < 60 AND s < 60 AND shift IS NOT NULL THEN epoch(day)::BIGINT + h * 3600 + mi * 60 + s - shift END AS seconds, clock, h, mi, st, frac, off,
  day IS NOT NULL AND (clock = '' OR (h < 24 AND mi < 60 AND s < 60 AND shift IS NOT NULL)) AS good
FROM (SELECT *, try_cast(ht AS INT) AS h, try_cast(mt AS INT) AS mi, CASE WHEN st = '' THEN 0 ELSE try_cast(st AS INT) END AS s,
    CASE WHEN off = '' THEN 32400 WHEN off = 'Z' THEN 0 WHEN try_cast(substring(off, 2, 2) AS INT) < 24 AND try_cast(substring(off, 5, 2) AS INT) < 60 THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (try_cast(substring(off, 2, 2) AS INT) * 3600 + try_cast(substring(off, 5, 2) AS INT) * 60) END AS shift
  FROM (SELECT *, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day,
      CASE WHEN korean THEN regexp_extract(clock, K, 1) ELSE regexp_extract(clock, C, 1) END AS ht, CASE WHEN korean THEN regexp_extract(clock, K, 2) ELSE regexp_extract(clock, C, 2) END AS mt,
      CASE WHEN korean THEN regexp_extract(clock, K, 3) ELSE regexp_extract(clock, C, 3) END AS st, CASE WHEN korean THEN regexp_extract(clock, K, 4) ELSE regexp_extract(clock, C, 4) END AS frac, CASE WHEN korean THEN '' ELSE regexp_extract(clock, C, 5) END AS off
    FROM (SELECT *, regexp_matches(clock, K) AS korean FROM (SELECT *, trim(regexp_extract(t, p, 4)) AS clock, regexp_extract(t, p, 1) AS y, regexp_extract(t, p, 2) AS m, regexp_extract(t, p, 3) AS d,
        '^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(Z|[+-][0-9]{2}:[0-9]{2})?$' AS C, '^([0-9]{1,2})시\s*([0-9]{1,2})분(?:\s*([0-9]{1,2})(?:\.([0-9]+))?초)?$' AS K
      FROM (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{4}-') THEN '^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9:.]+)?))?$'
          WHEN regexp_matches(t, '^[0-9]{4}년') THEN '^([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일(?:\s+(.+))?$' ELSE '^([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})(?:\s+(.+))?$' END AS p
        FROM (SELECT ordinal, deadline_raw AS raw, trim(deadline_raw) AS t FROM job))))))
"""


@query(f"""SELECT ordinal, CASE WHEN good AND clock = '' THEN day::VARCHAR WHEN good THEN day::VARCHAR || printf('T%02d:%02d', h, mi) || CASE WHEN st <> '' THEN printf(':%02d', try_cast(st AS INT)) ELSE '' END
  || CASE WHEN frac <> '' THEN '.' || frac ELSE '' END || CASE off WHEN 'Z' THEN '+00:00' WHEN '' THEN '+09:00' ELSE off END END AS text, CASE WHEN good THEN day END AS day, CASE WHEN good THEN seconds END AS seconds,
CASE WHEN good AND clock <> '' THEN rtrim(frac, '0') END AS fraction FROM ({STRICT})""")
def q_strict_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dates.with_strict_deadline(table(spark, sf_dir, "job").select("ordinal", "deadline_raw"), "deadline_raw")
    return rows.select("ordinal", "strict.text", "strict.day", "strict.seconds", "strict.fraction")


@query(f"""SELECT ordinal, CASE WHEN good AND seconds IS NOT NULL THEN CASE WHEN seconds >= {NOW} THEN 'open' ELSE 'expired' END WHEN good THEN CASE WHEN epoch(day) + 86400 - 32400 > {NOW} THEN 'open' ELSE 'expired' END
WHEN regexp_replace(raw, '\\s+', '', 'g') IN ('채용시마감','상시','상시채용','상시모집') THEN 'rolling' ELSE 'unknown' END AS state FROM ({STRICT})""")
def q_deadline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every posting."""
    rows = table(spark, sf_dir, "job").select("ordinal", "deadline_raw")
    return dates.with_strict_deadline(rows, "deadline_raw").select("ordinal", dates.deadline_state(F.col("strict"), F.col("deadline_raw"), NOW).alias("state"))


_COLLAPSE = "trim(regexp_replace(coalesce({0},''), '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


#: The raw deadline of a list row, and the deadline of a raw text with attested zone, in SQL.
_CJ_RAW = f"""CASE WHEN zz_till_hire = 'Y' THEN '채용시까지' ELSE {_COLLAPSE.format('zz_end_dt_str')} || CASE WHEN regexp_full_match(trim(coalesce(zz_end_hh, '')), '[0-9]{{1,2}}') AND regexp_full_match(trim(coalesce(zz_end_mi, '')), '[0-9]{{2}}') THEN ' ' || trim(zz_end_hh) || ':' || trim(zz_end_mi) ELSE '' END END"""


def _listed(raw: str) -> str:
    side = f"regexp_extract({raw}, '(?is)^(?:.*(?:[~～–—]|\\s-\\s|\\bto\\b))?(.*)$', 1)"
    date = "[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}"
    last = f"regexp_extract({side}, '(?s)^(?:.*[^0-9])?({date})', 1)"
    tail = f"regexp_extract({side}, '(?s)^(?:.*[^0-9])?{date}(.*)$', 1)"
    clock = f"regexp_extract({tail}, '^\\s*\\(?\\s*([0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?)', 1)"
    part = lambda i: f"lpad(regexp_split_to_array({last}, '[-./]')[{i}], 2, '0')"
    day = f"try_cast(lpad({part(1)}, 4, '0') || '-' || {part(2)} || '-' || {part(3)} AS DATE)"
    day = day.replace(f"lpad({part(1)}, 4, '0')", f"regexp_split_to_array({last}, '[-./]')[1]")
    moment = f"try_cast({day}::VARCHAR || ' ' || lpad(CASE WHEN length({clock}) < 6 THEN {clock} || ':00' ELSE {clock} END, 8, '0') AS TIMESTAMP)"
    listed = f"CASE WHEN {clock} = '' THEN {day}::VARCHAR WHEN {clock} LIKE '24:%' THEN NULL ELSE strftime({moment}, '%Y-%m-%dT%H:%M:%S') || '+09:00' END"
    iso = f"CASE WHEN length({raw}) = 10 THEN try_cast({raw} AS DATE)::VARCHAR WHEN regexp_matches({raw}, 'T.*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND try_cast({raw} AS TIMESTAMPTZ) IS NOT NULL THEN regexp_replace({raw}, 'Z$', '+00:00') END"
    return f"CASE WHEN {raw} <> '' AND NOT regexp_matches({raw}, '(?i)상시|채용 ?시|9999|2999|until') THEN CASE WHEN regexp_matches({raw}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T\\S+)?$') THEN {iso} ELSE {listed} END END"


@query(f"""SELECT row_no, 'https://recruit.navercorp.com/rcrt/view.do?annoId=' || annoId AS url, {_COLLAPSE.format('annoSubject')} AS title,
CASE WHEN {_COLLAPSE.format('sysCompanyCdNm')} = '' THEN 'Unknown employer' ELSE {_COLLAPSE.format('sysCompanyCdNm')} END AS company, {_COLLAPSE.format('endYmdTime')} AS deadline_raw, {_listed(_COLLAPSE.format('endYmdTime'))} AS deadline FROM collect_naver_page WHERE annoId IS NOT NULL AND {_COLLAPSE.format('annoSubject')} <> ''""")
def q_naver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.naver_rows(table(spark, sf_dir, "collect_naver_page")).select("row_no", "url", "title", "company", "deadline_raw", "deadline")


@query(f"""SELECT row_no, 'https://recruit.cj.net/recruit/ko/recruit/recruit/' || CASE gubun WHEN '1' THEN 'detail.fo?zz_jo_num=' || {_COLLAPSE.format('zz_jo_num')} ELSE 'bestDetail.fo?zz_jo_num=' || {_COLLAPSE.format('zz_jo_num')} || '&direct=N' END AS url,
{_COLLAPSE.format('zz_title')} AS title, {_CJ_RAW} AS deadline_raw, {_listed(_CJ_RAW)} AS deadline FROM collect_cj_page WHERE gubun IN ('1','2') AND regexp_full_match({_COLLAPSE.format('zz_jo_num')}, '[0-9]+|J[0-9]+') AND {_COLLAPSE.format('zz_title')} <> ''""")
def q_cj_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.cj_rows(table(spark, sf_dir, "collect_cj_page")).select("row_no", "url", "title", "deadline_raw", "deadline")


@query("SELECT curdate, count(*) AS rows, CASE WHEN min(tot_cnt) = max(tot_cnt) THEN min(tot_cnt) END AS total, coalesce(min(tot_cnt) <> max(tot_cnt), false) AS inconsistent FROM collect_cj_page GROUP BY curdate")
def q_consistent_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.consistent_total(table(spark, sf_dir, "collect_cj_page"), "tot_cnt", "curdate")


@query("SELECT status, count(*) AS n FROM integration_live GROUP BY status")
def q_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.histogram(table(spark, sf_dir, "integration_live"), "status")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS first_at, count(*) AS events FROM events GROUP BY user_id")
def q_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.latest_by(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "value")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = table(spark, sf_dir, "companies_2").unionByName(table(spark, sf_dir, "companies_3"))
    return catalog.all_sources(companies, table(spark, sf_dir, "portals"))


_SOURCES = "(SELECT id, name_ko, name_en, aliases, careers_url, access_mode, 'company' AS kind FROM companies_2 UNION ALL SELECT id, name_ko, name_en, aliases, careers_url, access_mode, 'company' FROM companies_3 UNION ALL SELECT id, name_ko, name_en, []::VARCHAR[], careers_url, access_mode, 'portal' FROM portals)"


@query(f"SELECT coalesce(s.kind, 'unlisted') AS kind, count(*) AS postings, count(DISTINCT j.source_id) AS sources FROM job j LEFT JOIN {_SOURCES} s ON s.id = j.source_id GROUP BY 1")
def q_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = table(spark, sf_dir, "job").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    met = job.join(_sources(spark, sf_dir).select("id", "kind"), "id", "left")
    return met.groupBy(F.coalesce("kind", F.lit("unlisted")).alias("kind")).agg(F.sum("n").alias("postings"), F.count("id").alias("sources"))


@query(f"SELECT id FROM {_SOURCES} s WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.source_id = s.id)")
def q_sources_without_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("id").join(table(spark, sf_dir, "job").select(F.col("source_id").alias("id")), "id", "left_anti")


@query(f"""WITH n AS (SELECT s.id, lower(x) AS name FROM (SELECT id, unnest(list_concat([id, name_ko, name_en], coalesce(aliases, []))) AS x FROM {_SOURCES}) s WHERE x IS NOT NULL),
m AS (SELECT sel AS selector, n.id, max(n.name = lower(sel)) AS exact FROM n JOIN (VALUES ('kr-001'), ('media'), ('portal'), ('전자')) v(sel) ON contains(n.name, lower(sel)) GROUP BY sel, n.id)
SELECT selector, id, exact FROM m WHERE exact = (SELECT max(exact) FROM m m2 WHERE m2.selector = m.selector)""")
def q_resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = spark.createDataFrame([(s,) for s in ("kr-001", "media", "portal", "전자")], "selector string")
    return catalog.resolve(_sources(spark, sf_dir), picks)


@query("""WITH r AS (SELECT * FROM companies_2 UNION ALL SELECT * FROM companies_3), c AS (
SELECT id, 'duplicate_name' AS code FROM r WHERE lower(trim(name_ko)) IN (SELECT lower(trim(name_ko)) FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT id, 'duplicate_index' FROM r WHERE selection_index IN (SELECT selection_index FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT id, 'no_english_name' FROM r WHERE coalesce(trim(name_en), '') = ''
UNION ALL SELECT id, 'bad_access_mode' FROM r WHERE coalesce(access_mode, '') NOT IN ('html','public_api','browser','manual')
UNION ALL SELECT id, 'bad_status' FROM r WHERE coalesce(verification.status, '') NOT IN ('verified','partial','blocked','unverified')) SELECT * FROM c""")
def q_catalog_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "companies_2").unionByName(table(spark, sf_dir, "companies_3"))
    return catalog.violations(rows)


@query(f"""SELECT 'discover-' || id AS task_id, CASE kind WHEN 'company' THEN 0 ELSE 1 END AS priority,
'site:' || lower(regexp_extract(careers_url, '^[a-z]+://([^/?#:]+)', 1)) || ' "' || name_ko || '" 데이터 채용' AS query FROM {_SOURCES}""")
def q_discovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.discovery_plan(_sources(spark, sf_dir), "데이터").select("task_id", "priority", "query")


@query(f"SELECT id, CASE WHEN base <> id THEN base END AS shared_with FROM (SELECT id, min(id) OVER (PARTITION BY careers_url) AS base FROM {_SOURCES} WHERE careers_url IS NOT NULL)")
def q_shared_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.shared_portals(_sources(spark, sf_dir))


@query("SELECT source_id, ordinal, n > 5 AS truncated FROM (SELECT source_id, ordinal, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY source_id) AS n FROM job WHERE source_id IS NOT NULL) WHERE r <= 5")
def q_limit_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.per_source_limit(table(spark, sf_dir, "job").select("source_id", "ordinal").filter("source_id IS NOT NULL"), "source_id", "ordinal", 5)


@query("""SELECT source_id, batch_no, CASE WHEN n_full < n THEN 'partial' ELSE 'ok' END AS state FROM (SELECT source_id, batch_no, count(*) AS n, count(*) FILTER (WHERE evidence.completeness = 'full_text') AS n_full FROM job GROUP BY ALL)""")
def q_acquisition_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job").groupBy("source_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence.completeness") == "full_text").alias("full"))
    no = F.lit(False)
    return rows.select("source_id", "batch_no", acquire.batch_state(F.col("n"), F.col("full"), no, no, F.lit(None).cast("long")).alias("state"))


@query("""SELECT source_id, batch_no, n FROM (SELECT source_id, batch_no, n, coalesce(sum(n) OVER w, 0) AS before FROM (SELECT source_id, batch_no, count(*) AS n FROM job WHERE batch_no BETWEEN 1 AND 3 GROUP BY ALL)
WINDOW w AS (PARTITION BY source_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE before < 10""")
def q_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "job").groupBy("source_id", "batch_no").agg(F.count(F.lit(1)).alias("n"))
    return acquire.capped_pages(pages, "source_id", "batch_no", "n", 10)


RULES = "User-agent: *\nDisallow: /posting/\nAllow: /posting/0000*1$\nDisallow: /*rec_idx=\nAllow: /zf/view?rec_idx=5000\nDisallow: /Jobs$\n"


@query("""WITH p AS (SELECT ordinal, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) AS path FROM job WHERE url IS NOT NULL AND url <> ''),
r(re, allow, size) AS (VALUES ('^/posting/', false, 9), ('^/posting/0000.*1$', true, 14), ('^/.*rec_idx=', false, 9), ('^/zf/view\\?rec_idx=5000', true, 21), ('^/Jobs$', false, 5)),
m AS (SELECT ordinal, arg_max(allow, size * 2 + allow::INT) AS allow FROM p JOIN r ON regexp_matches(p.path, r.re) GROUP BY ordinal)
SELECT p.ordinal, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m USING (ordinal)""")
def q_robots_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.rules_table(spark.createDataFrame([("any", RULES)], "origin string, text string"), "origin", "text", "collector")
    paths = table(spark, sf_dir, "job").filter("url <> ''").select("ordinal", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+([^#]*)", 1).alias("path"), F.lit("any").alias("at"))
    return robots.permits(paths, rules, "ordinal", "path", "at")


@query("""SELECT doc_id, kind FROM (SELECT doc_id, text, unnest(['private_key','access_key','token']) AS kind FROM documents) WHERE CASE kind WHEN 'private_key' THEN regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')
WHEN 'access_key' THEN regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') ELSE regexp_matches(text, '(?i)\\b(api[_-]?key|secret|token)\\b\\s*[:=]\\s*["'']?[A-Za-z0-9_\\-]{16,}') END""")
def q_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.secret_kinds(F.col("text"))).alias("kind"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '(?i)<(img|iframe|object)\\b'), false) AS media FROM documents")
def q_media_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.media_flag(F.col("text")).alias("media"))


@query("""SELECT ordinal, CASE WHEN NOT json_exists(ext, '$.remote') THEN 'absent' WHEN json_type(ext, '$.remote') = 'NULL' THEN 'null' ELSE 'value' END AS remote,
CASE WHEN NOT json_exists(ext, '$.headcount') THEN 'absent' WHEN json_type(ext, '$.headcount') = 'NULL' THEN 'null' ELSE 'value' END AS headcount FROM job WHERE ext IS NOT NULL""")
def q_null_or_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job").filter("ext IS NOT NULL").select("ordinal", F.try_parse_json("ext").alias("v"))
    return rows.select("ordinal", *[listings.key_state(F.col("v"), k).alias(k) for k in ("remote", "headcount")])


_BLANK = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}\\x0b]"


@query(f"""SELECT doc_id, substring(list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '')[1], 1, 200) AS title
FROM documents WHERE text IS NOT NULL""")
def q_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.first_line(F.col("text")).alias("title"))


@query("SELECT ordinal, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS shown FROM job")
def q_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job").select("ordinal", text.html_escape(F.col("title")).alias("shown"))
