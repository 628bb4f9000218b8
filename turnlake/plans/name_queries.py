"""Queries on names and label correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..operators import names as M
from ..operators import ops_log as O
from ..operators import bank as B
from .registry import query

_N = r"regexp_replace(lower({0}),'[^\p{{L}}\p{{N}}]','','g')"


@query("name_lookup", "H1 C12", "SELECT kind, norm, canonical, conf FROM lookup", "lookup")
def name_lookup(t):
    return M.name_lookup(t.cast, t.bank_names)


@query("canonical_metadata", "H1", """SELECT c.canonical, c.role, NULL::VARCHAR AS speaker_key, 'config' AS source FROM castv c
  UNION ALL SELECT canonical, NULL, speaker_key, 'bank' FROM bank_names""", "castv bank_names")
def canonical_metadata(t):
    return M.canonical_metadata(t.cast, t.bank_names)


@query("canonical_names", "G6", "SELECT DISTINCT canonical FROM lookup WHERE kind='canonical'", "lookup")
def canonical_names(t):
    return M.canonical_names(M.name_lookup(t.cast, t.bank_names))


@query("lookup_name", "D5", rf"""SELECT h.nid, x.canonical, x.kind AS method, x.conf FROM heard h LEFT JOIN (SELECT * FROM lookup
  QUALIFY row_number() OVER (PARTITION BY norm ORDER BY CASE kind WHEN 'canonical' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END)=1) x ON x.norm={_N.format('h.heard')}""", "heard lookup")
def lookup_name(t):
    names = t.heard.withColumn("norm", norm_name(F.col("heard")))
    return M.lookup_name(names, M.name_lookup(t.cast, t.bank_names)).select("nid", "canonical", "method", "conf")


def _missed(t):
    names = t.heard.select(norm_name(F.col("heard")).alias("norm")).distinct()
    exact = M.lookup_name(names, M.name_lookup(t.cast, t.bank_names))
    return exact.filter(F.col("canonical").isNull()).select("norm")


@query("fuzzy_name", "D6", "SELECT norm, canonical, method, round(conf,6) AS conf FROM resolved WHERE method IN ('fuzzy','no_match')", "resolved")
def fuzzy_name(t):
    got = M.fuzzy_name(_missed(t), M.cast_candidates(t.cast, t.bank_names), method="levenshtein")
    return got.withColumn("conf", F.round("conf", 6))


@query("fuzzy_name_ratio", "D6")
def fuzzy_name_ratio(t):
    """Matching-blocks ratio: not expressible in SQL, checked against brute force in the tests."""
    return M.fuzzy_name(_missed(t), M.cast_candidates(t.cast, t.bank_names))


@query("correct_names", "M9 D5 D6", rf"""SELECT DISTINCT h.heard AS name, h.heard AS cleaned, coalesce(r.canonical, h.heard) AS corrected, r.canonical, r.method, round(r.conf,6) AS conf
  FROM heard h JOIN resolved r ON r.norm={_N.format('h.heard')}""", "heard resolved")
def correct_names(t):
    got = M.correct_names(t.heard.select(F.col("heard").alias("name")), t.cast, t.bank_names, method="levenshtein")
    return got.withColumn("conf", F.round("conf", 6))


_APPLY = "r.canonical IS NOT NULL AND r.canonical<>h.heard AND r.conf>=0.9"


def _spoken_names(t):
    return t.heard.select((F.col("nid") % 50).alias("episode_id"), F.col("nid").alias("seg_id"), F.col("heard").alias("speaker"))


@query("correct_speakers", "D7", rf"""SELECT h.nid%50 AS episode_id, h.nid AS seg_id, CASE WHEN {_APPLY} THEN r.canonical ELSE h.heard END AS speaker,
  CASE WHEN {_APPLY} THEN h.heard END AS original_speaker, CASE WHEN {_APPLY} THEN r.method END AS method, CASE WHEN {_APPLY} THEN round(r.conf,6) END AS correction_conf
  FROM heard h JOIN resolved r ON r.norm={_N.format('h.heard')}""", "heard resolved")
def correct_speakers(t):
    got = M.correct_speakers(_spoken_names(t), t.cast, t.bank_names, method="levenshtein")
    return got.withColumn("correction_conf", F.round("correction_conf", 6))


@query("correction_log", "D7", rf"""SELECT h.nid%50 AS episode_id, h.nid AS seg_id, h.heard AS original_text, r.canonical AS corrected_text, r.method, round(r.conf,6) AS confidence
  FROM heard h JOIN resolved r ON r.norm={_N.format('h.heard')} WHERE {_APPLY}""", "heard resolved")
def correction_log(t):
    got = M.correct_speakers(_spoken_names(t), t.cast, t.bank_names, method="levenshtein")
    return M.correction_log(got).withColumn("confidence", F.round("confidence", 6))


@query("correct_text_labels", "D8", rf"""SELECT l.doc_id, l.line_no, CASE WHEN ok THEN '[00:00:15] '||canonical||': said number '||line_no ELSE line END AS line, coalesce(ok,false) AS changed FROM (
  SELECT l.*, r.canonical, r.canonical IS NOT NULL AND r.conf>=0.9 AND r.canonical<>split_part(split_part(l.line,'] ',2),': ',1) AS ok
  FROM lines l JOIN heard h ON h.nid=l.line_no JOIN resolved r ON r.norm={_N.format('h.heard')}) l""", "lines resolved")
def correct_text_labels(t):
    return M.correct_text_labels(t.lines, t.cast, t.bank_names, method="levenshtein")


@query("name_search", "C32", "SELECT DISTINCT canonical FROM lookup WHERE kind='canonical' AND contains(lower(canonical),'ri')", "lookup")
def name_search(t):
    return M.name_search(M.canonical_names(M.name_lookup(t.cast, t.bank_names)), "Ri")


@query("suggest", "C32 F14", rf"""SELECT n.norm, c.canonical, round(c.score,6) AS score, c.rank FROM (SELECT DISTINCT {_N.format('heard')} AS norm FROM heard) n,
  LATERAL (SELECT canonical, score, row_number() OVER (ORDER BY score DESC, canonical) AS rank FROM (
   SELECT c.canonical, 1-levenshtein(n.norm,c.norm)::DOUBLE/greatest(length(n.norm),length(c.norm)) AS score FROM cands c) WHERE score>=0.65 ORDER BY score DESC, canonical LIMIT 3) c""", "heard cands")
def suggest(t):
    names = t.heard.select(norm_name(F.col("heard")).alias("norm"))
    got = M.suggest(names, M.cast_candidates(t.cast, t.bank_names), method="levenshtein")
    return got.withColumn("score", F.round("score", 6))


@query("attach_cast", "D16", """SELECT h.nid, array_to_string(coalesce(c.aliases,[]),',') AS aliases, array_to_string(coalesce(c.misspellings,[]),',') AS misspellings
  FROM heard h LEFT JOIN castv c ON lower(c.canonical)=lower(h.heard)""", "heard castv")
def attach_cast(t):
    got = B.attach_cast(t.heard.select("nid", F.col("heard").alias("display_name")), t.cast)
    return got.select("nid", F.array_join("aliases", ",").alias("aliases"), F.array_join("misspellings", ",").alias("misspellings"))


@query("cast_snapshot", "B11", """SELECT 'show'||(ord%3) AS "show", ord%4+1 AS season, 'S'||lpad((ord%4+1)::VARCHAR,2,'0') AS season_code, ord, canonical,
  ord%4+1=2 OR (ord%4+1)%2=1 AS changed FROM castv""", "castv")
def cast_snapshot(t):
    """The previous snapshot lacks season 2 and held another name in odd seasons."""
    members = t.cast.withColumn("show", F.concat(F.lit("show"), (F.col("ord") % 3).cast("string"))).withColumn("season", F.col("ord") % 4 + 1)
    before = O.cast_snapshot(members).filter("season <> 2").withColumn(
        "canonical", F.when(F.col("season") % 2 == 0, F.col("canonical")).otherwise("old")
    )
    return O.cast_snapshot(members, before)
