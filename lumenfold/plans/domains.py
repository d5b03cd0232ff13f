"""Domains of files that customers stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import domains
from lumenfold.plans.registry import load, query

#: Headers, names and values that files are made of, by their numbers.
_HEADERS = ["qco_number", "effective_date", "test_id", "lab_id", "lab_name", "question", "answer", "country", "standard_id", "revision", "remarks", "parameter"]
_NAMES = ["qco list", "list_scheme_iv_coc", "faq of hallmark", "source_inventory", "laboratory_scopes", "notes", "circular act", "ahc_2"]
_VALUES = ["certificate of conformity", "gazette notification", "isi  mark", "schemes without", "assaying & hallmarking", "nothing"]
_SCHEMES = ["Scheme - IV", "scheme ii", "FMCS", "isi mark", "Scheme 1", "none", "SCH-X", "Scheme-I"]


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _re2(pattern: str) -> str:
    """A pattern without looking around, which finds the same where no match is taken out."""
    return pattern.replace("(?<![a-z0-9])", "(?:^|[^a-z0-9])").replace("(?![a-z0-9])", "(?:[^a-z0-9]|$)").replace("(?![A-Z0-9])", "(?:[^A-Z0-9]|$)").replace("(?![IVX0-9])", "(?:[^IVX0-9]|$)").replace("(?![0-9])", "(?:[^0-9]|$)")


def _label(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{_re2(p)}') THEN '{d}'" for p, d in domains.SCHEME_TOKENS) + " END"


def _score(heads: list[str], values: list[str]) -> str:
    parts = [f"3 * len(list_filter(headers, lambda h: regexp_matches(h, '{'|'.join(f'(?:{x})' for x in heads)}')))"] if heads else []
    return " + ".join(parts + [f"(CASE WHEN regexp_matches(name, '{_re2(p)}') OR regexp_matches(sample, '{_re2(p)}') THEN 2 ELSE 0 END)" for p in values])


_FILES = f"""files AS (SELECT c_custkey AS file_id, {_quoted(_NAMES)}[c_custkey % 8 + 1] AS name, list_distinct([{_quoted(_HEADERS)}[c_custkey % 12 + 1], {_quoted(_HEADERS)}[(c_custkey // 5) % 12 + 1], {_quoted(_HEADERS)}[(c_custkey // 7) % 12 + 1]]) AS headers,
  {_quoted(_VALUES)}[c_custkey % 6 + 1] || ' ' || {_quoted(_VALUES)}[(c_custkey // 6) % 6 + 1] AS sample FROM customer),
cells AS (SELECT o_custkey AS file_id, (['scheme_name', 'scheme_id', 'scheme_type', 'remarks'])[o_orderkey % 4 + 1] AS header, {_quoted(_SCHEMES)}[(o_custkey + o_orderkey // 9 % 3) % 8 + 1] AS value, 1 AS n FROM orders),
counted AS (SELECT file_id, header, CASE header WHEN 'scheme_name' THEN 3 WHEN 'scheme_id' THEN 2 ELSE 1 END AS rank, {_label("upper(value)")} AS domain, count(*) AS n FROM cells WHERE header <> 'remarks' GROUP BY ALL),
facts AS (SELECT *, sum(n) OVER (PARTITION BY file_id, header) AS every, sum(n) FILTER (domain IS NOT NULL) OVER (PARTITION BY file_id, header) AS bearing, row_number() OVER (PARTITION BY file_id, header ORDER BY domain IS NULL, n DESC, domain) AS nth FROM counted),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rank DESC, n DESC, header) AS place FROM facts WHERE domain IS NOT NULL AND nth = 1 AND n >= 0.6 * bearing AND (n >= 3 OR n >= 0.5 * every)),
schemes AS (SELECT file_id, domain, CASE WHEN min(place) > 1 THEN 3 WHEN arg_min(rank, place) >= 2 THEN 7 ELSE 5 END AS points FROM best GROUP BY 1, 2)"""


@query(f"WITH {_FILES} SELECT * FROM schemes")
def dominant_schemes(spark, sf_dir):
    return domains.dominant_schemes(_cells(spark, sf_dir))


def _cells(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(c.alias("file_id"), pick(["scheme_name", "scheme_id", "scheme_type", "remarks"], k).alias("header"), pick(_SCHEMES, c + F.floor(k / 9) % 3).alias("value"), F.lit(1).alias("n"))


@query(f"""WITH {_FILES}, each AS (SELECT file_id, unnest({_quoted([d for d, _, _ in domains.DOMAINS])}) AS domain, unnest([{', '.join(_score(h, v) for _, h, v in domains.DOMAINS)}]) AS score FROM files
  {' '.join(f"UNION ALL SELECT file_id, '{d}', CASE WHEN regexp_matches(name, '{p}') THEN {n} ELSE 0 END FROM files" for p, d, n in domains.NAME_SIGNALS)} UNION ALL SELECT s.* FROM schemes s JOIN files USING (file_id)),
scores AS (SELECT file_id, domain, sum(score)::BIGINT AS score FROM each WHERE score > 0 GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, domain) AS nth FROM scores),
top AS (SELECT file_id, max(score) AS score, min(domain) FILTER (nth = 1) AS first, string_agg(domain, ';' ORDER BY nth) FILTER (nth > 1 AND nth <= 5 AND score >= 5) AS others, string_agg(domain, ';' ORDER BY nth) FILTER (nth <= 3) AS three FROM ranked GROUP BY 1)
SELECT file_id, CASE WHEN score >= 5 THEN first ELSE 'UNKNOWN' END AS domain, coalesce(CASE WHEN score >= 5 THEN others ELSE three END, '') AS secondary, coalesce(score, 0) AS score FROM files LEFT JOIN top USING (file_id)""")
def file_domains(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    files = load(spark, sf_dir, "customer").select(
        k.alias("file_id"), pick(_NAMES, k).alias("name"), F.array(pick(_HEADERS, k), pick(_HEADERS, F.floor(k / 5)), pick(_HEADERS, F.floor(k / 7))).alias("headers"), F.concat_ws(" ", pick(_VALUES, k), pick(_VALUES, F.floor(k / 6))).alias("sample"),
    )
    schemes = domains.dominant_schemes(_cells(spark, sf_dir)).join(files.select("file_id"), "file_id", "left_semi")
    return domains.file_domains(files, domains.domain_scores(files, schemes))
