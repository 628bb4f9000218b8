"""Queries on error rates and tool comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..session import scratch_path
from ..sources.writers import write_csv
from .registry import query
from .sqltext import edit_ctes, norm_words, rnd, simple_words

def _pairs(key: str, src: str) -> str:
    return f"SELECT {key} AS k, {norm_words('ref_text')} AS ref, {norm_words('hyp_text')} AS hyp FROM {src}"


_RATE = f"{rnd('num_errors/num_words', 4)} AS wer, {rnd('num_errors/num_words*100', 2)} AS wer_pct"
_SEGKEY = "{'episode_id': episode_id, 'seg_id': seg_id}"
_TOOLKEY = "{'episode_id': episode_id, 'seg_id': seg_id, 'tool': tool}"
_HYP = edit_ctes(_pairs(_SEGKEY, "hyp"))
_TOOLS = edit_ctes(_pairs(_TOOLKEY, "hyp_tools"))


@query("wer", "E13", f"SELECT k.episode_id, k.seg_id, substitutions, insertions, deletions, num_words, num_errors, {_RATE} FROM counts", "hyp", _HYP, True)
def wer(t):
    return S.wer(t.hyp, ["episode_id", "seg_id"])


@query("wer_simple", "E14", "SELECT k.episode_id, k.seg_id, round(num_errors/num_words,6) AS wer FROM counts", "hyp",
       edit_ctes(f"SELECT {_SEGKEY} AS k, {simple_words('ref_text')} AS ref, {simple_words('hyp_text')} AS hyp FROM hyp"), True)
def wer_simple(t):
    return S.wer_simple(t.hyp, ["episode_id", "seg_id"]).withColumn("wer", F.round("wer", 6))


def _tool_counts(t):
    return S.wer(t.hyp_tools, ["episode_id", "seg_id", "tool"])


@query("corpus_wer", "E15", "SELECT k.tool AS tool, sum(num_errors)::BIGINT AS num_errors, sum(num_words)::BIGINT AS num_words, round(sum(num_errors)/sum(num_words),6) AS wer FROM counts GROUP BY 1", "hyp_tools", _TOOLS, True)
def corpus_wer(t):
    return S.corpus_wer(_tool_counts(t), ["tool"]).withColumn("wer", F.round("wer", 6))


_CLIP = "(SELECT k.episode_id AS clip, k.tool AS scenario, round(sum(num_errors)/sum(num_words),9) AS wer FROM counts GROUP BY ALL)"


@query("wer_delta", "E25", f"SELECT r.clip, r.scenario, round(r.wer,6) AS wer, round((b.wer-r.wer)/b.wer*100,6) AS delta_pct FROM {_CLIP} r JOIN {_CLIP} b ON r.clip=b.clip AND b.scenario='asr_a'", "hyp_tools", _TOOLS, True)
def wer_delta(t):
    by = S.corpus_wer(_tool_counts(t), ["episode_id", "tool"]).select(
        F.col("episode_id").alias("clip"), F.col("tool").alias("scenario"), F.round("wer", 9).alias("wer")
    )
    got = S.wer_delta(by, "asr_a")
    return got.withColumn("wer", F.round("wer", 6)).withColumn("delta_pct", F.round("delta_pct", 6))


_DOC = edit_ctes(
    f"SELECT episode_id AS k, flatten(list({norm_words('ref_text')} ORDER BY seg_id)) AS ref, flatten(list({norm_words('hyp_text')} ORDER BY seg_id)) AS hyp FROM hyp GROUP BY 1"
)
_COUNTS = "substitutions, insertions, deletions, num_words, num_errors"


@query("document_wer", "E13 C23", f"SELECT k AS episode_id, {_COUNTS}, {_RATE} FROM counts", "hyp", _DOC, True)
def document_wer(t):
    """Whole-episode texts aligned in one matrix each, in tiles."""
    seg = t.hyp.select("episode_id", "seg_id", "ref_text", "hyp_text")
    return S.document_wer(
        seg.select("episode_id", "seg_id", F.col("ref_text").alias("text")),
        seg.select("episode_id", "seg_id", F.col("hyp_text").alias("text")), ["episode_id"],
    )


def _spk(src: str, who: str) -> str:
    return (
        f"SELECT episode_id, list(tok ORDER BY speaker, start_ms, seg_id, word_idx) AS toks FROM (SELECT episode_id, {who} AS speaker, start_ms, seg_id, word_idx,"
        f" array_to_string({norm_words('word')},' ') AS tok FROM {src} UNION ALL SELECT DISTINCT episode_id, {who}, -1, -1, -1, lower({who}) FROM {src}) WHERE tok<>'' GROUP BY 1"
    )


_CP = edit_ctes(f"SELECT r.episode_id AS k, r.toks AS ref, h.toks AS hyp FROM ({_spk('word', 'said_by')}) r JOIN ({_spk('aligned', 'speaker')}) h USING (episode_id)")


@query("cpwer", "E16", f"SELECT k AS episode_id, {_COUNTS}, {_RATE} FROM counts", "word aligned", _CP, True)
def cpwer(t):
    words = t.aligned.select("episode_id", "seg_id", "word_idx", "word", "start_ms", "speaker")
    ref = t.word.select("episode_id", "seg_id", "word_idx", "word", "start_ms", F.col("said_by").alias("speaker"))
    return S.cpwer(words, ref)


@query("speaker_tokens", "E16", f"""SELECT episode_id, tok, row_number() OVER (PARTITION BY episode_id ORDER BY speaker, start_ms, seg_id, word_idx)-1 AS pos FROM (
  SELECT episode_id, speaker, start_ms, seg_id, word_idx, array_to_string({norm_words('word')},' ') AS tok FROM aligned UNION ALL
  SELECT DISTINCT episode_id, speaker, -1, -1, -1, lower(speaker) FROM aligned) WHERE tok<>''""", "aligned")
def speaker_tokens(t):
    words = t.aligned.select("episode_id", "seg_id", "word_idx", "word", "start_ms", "speaker")
    return S.speaker_tokens(words).select("episode_id", "tok", "pos")


_FRAMES = """SELECT episode_id, f, arg_max(speaker, turn_id) AS speaker FROM (SELECT t.episode_id, t.turn_id, t.speaker,
  unnest(range(t.start_ms//10, least(t.end_ms//10, d.duration_ms//10))) AS f FROM {0} t JOIN duration d USING (episode_id)) GROUP BY ALL"""


def _der_sql(hyp: str) -> str:
    return f"""WITH r AS ({_FRAMES.format('ref_turn')}), h AS ({_FRAMES.format(hyp)}), j AS (SELECT coalesce(r.episode_id,h.episode_id) AS episode_id,
   count(r.f) AS ref_frames, count(*) FILTER (h.f IS NULL) AS missed, count(*) FILTER (r.f IS NULL) AS false_alarm, count(*) FILTER (r.speaker<>h.speaker) AS confusion
   FROM r FULL JOIN h ON r.episode_id=h.episode_id AND r.f=h.f GROUP BY 1)
  SELECT d.episode_id, d.duration_ms//10 AS total_frames, j.ref_frames, j.missed, j.false_alarm, j.confusion,
   {rnd('(missed+false_alarm+confusion)/ref_frames', 4)} AS der, {rnd('(missed+false_alarm+confusion)/ref_frames*100', 2)} AS der_pct FROM duration d JOIN j USING (episode_id)"""


@query("der", "E17 E17b F13 M15", _der_sql("turn"), "ref_turn turn duration")
def der(t):
    return S.der(t.ref_turn, t.turn, t.duration)


@query("der_overlapping", "E17 F13", _der_sql("turn_ovl"), "ref_turn turn_ovl duration")
def der_overlapping(t):
    return S.der(t.ref_turn, t.turn_ovl, t.duration)


_TICKS = "SELECT DISTINCT episode_id, speaker, unnest(range(start_ms//100, end_ms//100)) AS k FROM {0}"
_SETS = f"""WITH r AS ({_TICKS.format('ref_turn')}), h AS ({_TICKS.format('turn_ovl')}), j AS (SELECT coalesce(r.episode_id,h.episode_id) AS episode_id, count(r.k) AS ref_ticks, count(h.k) AS hyp_ticks,
   count(*) FILTER (r.k IS NOT NULL AND h.k IS NOT NULL) AS common_ticks, count(*) AS all_ticks FROM r FULL JOIN h ON r.episode_id=h.episode_id AND r.speaker=h.speaker AND r.k=h.k GROUP BY 1)"""


@query("jer", "E18", f"{_SETS} SELECT episode_id, {rnd('1-common_ticks/all_ticks', 4)} AS jer FROM j", "ref_turn turn_ovl")
def jer(t):
    return S.jer(t.ref_turn, t.turn_ovl)


@query("tick_sets", "H3", f"{_SETS} SELECT * FROM j", "ref_turn turn_ovl")
def tick_sets(t):
    return S.tick_sets(t.ref_turn, t.turn_ovl)


def _tool_rows(t, stage):
    return t.runtime.filter(F.col("stage") == stage).select("clip", "tool")


_GRID = """SELECT * FROM (SELECT DISTINCT clip, tool AS asr FROM runtime WHERE stage='asr') JOIN (SELECT DISTINCT clip, tool AS dia FROM runtime WHERE stage='diarization') USING (clip)"""


@query("tool_grid", "D13", _GRID, "runtime")
def tool_grid(t):
    return S.tool_grid(_tool_rows(t, "asr"), _tool_rows(t, "diarization"))


@query("pair_refs", "D14", """SELECT r.event_id, r.clip, d.duration_ms, 'paired' AS state FROM runtime r JOIN duration d ON d.episode_id=r.clip
  UNION ALL SELECT event_id, clip, NULL, 'missing reference' FROM runtime WHERE clip NOT IN (SELECT episode_id FROM duration)""", "runtime duration")
def pair_refs(t):
    ref = t.duration.withColumnRenamed("episode_id", "clip")
    paired, missing = S.pair_refs(t.runtime.select("event_id", "clip"), ref)
    return paired.select("event_id", "clip", "duration_ms", F.lit("paired").alias("state")).unionByName(
        missing.select("event_id", "clip", F.lit(None).cast("bigint").alias("duration_ms"), F.lit("missing reference").alias("state"))
    )


@query("pending", "D15", "SELECT DISTINCT clip, tool FROM runtime EXCEPT SELECT DISTINCT clip, tool FROM runtime WHERE stage='asr' AND rtf IS NOT NULL AND duration_s>60", "runtime")
def pending(t):
    done = t.runtime.filter("stage = 'asr' AND rtf IS NOT NULL AND duration_s > 60").select("clip", "tool").distinct()
    return S.pending(t.runtime.select("clip", "tool").distinct(), done, ["clip", "tool"])


# Published weights of the comparison.
WEIGHTS = {"wer": 0.25, "cpwer": 0.10, "der": 0.15, "rtf_asr": 0.10, "rtf_dia": 0.10, "stability": 0.10, "simplicity": 0.10, "integration": 0.10}


@query("decision_matrix", "E26", """WITH s AS (SELECT tool, CASE stage WHEN 'asr' THEN 'rtf_asr' ELSE 'rtf_dia' END AS metric, rtf AS value FROM runtime WHERE rtf IS NOT NULL
   UNION ALL SELECT tool, 'wer', duration_s FROM runtime UNION ALL SELECT tool, 'unweighted', 1.0 FROM runtime),
  m AS (SELECT tool, metric, avg(value) AS v FROM s GROUP BY ALL), r AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1)
  SELECT tool, round(sum(CASE WHEN hi>lo THEN (hi-v)/(hi-lo) ELSE 1 END*CASE metric WHEN 'wer' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END),6) AS score, count(*) AS metrics
  FROM m JOIN r USING (metric) WHERE metric<>'unweighted' GROUP BY 1""", "runtime")
def decision_matrix(t):
    rt = t.runtime
    scores = (
        rt.filter("rtf IS NOT NULL").select("tool", F.when(F.col("stage") == "asr", "rtf_asr").otherwise("rtf_dia").alias("metric"), F.col("rtf").alias("value"))
        .unionByName(rt.select("tool", F.lit("wer").alias("metric"), F.col("duration_s").alias("value")))
        .unionByName(rt.select("tool", F.lit("unweighted").alias("metric"), F.lit(1.0).alias("value")))
    )
    return S.decision_matrix(scores, WEIGHTS).withColumn("score", F.round("score", 6))


@query("stability", "E27", "SELECT tool, stage, count(rtf) AS runs, round(var_pop(rtf),6) AS rtf_var, round(stddev_pop(rtf),6) AS rtf_std FROM runtime GROUP BY ALL", "runtime")
def stability(t):
    got = S.stability(t.runtime)
    return got.withColumn("rtf_var", F.round("rtf_var", 6)).withColumn("rtf_std", F.round("rtf_std", 6))


def _report(t):
    """Two recognisers and two diarizers over every episode; run times renamed to the tools."""
    clip = lambda df, tool: df.select(F.col("episode_id").alias("clip"), F.lit(tool).alias("tool"))
    asr = clip(t.duration, "asr_a").unionByName(clip(t.duration, "asr_b"))
    dia = clip(t.duration, "dia_a").unionByName(clip(t.duration, "dia_b"))
    text = t.hyp_tools.select("episode_id", "tool", "seg_id", "ref_text", "hyp_text")
    counts = S.document_wer(
        text.select("episode_id", "tool", "seg_id", F.col("ref_text").alias("text")),
        text.select("episode_id", "tool", "seg_id", F.col("hyp_text").alias("text")),
        ["episode_id", "tool"],
    ).withColumnsRenamed({"episode_id": "clip", "tool": "asr"})
    label = lambda df, tool: df.withColumn("dia", F.lit(tool)).withColumnRenamed("episode_id", "clip")
    der_rows = label(S.der(t.ref_turn, t.turn, t.duration), "dia_a").unionByName(label(S.der(t.ref_turn, t.turn_ovl, t.duration), "dia_b"))
    jer_rows = label(S.jer(t.ref_turn, t.turn), "dia_a").unionByName(label(S.jer(t.ref_turn, t.turn_ovl), "dia_b"))
    a = F.col("event_id") % 4 < 2
    log = t.runtime.withColumn(
        "tool",
        F.when(F.col("stage") == "asr", F.when(a, "asr_a").otherwise("asr_b")).otherwise(F.when(a, "dia_a").otherwise("dia_b")),
    )
    return S.eval_report(
        S.tool_grid(asr, dia), t.duration.withColumnRenamed("episode_id", "clip"), counts, der_rows, jer_rows, log
    )


_JER = f"{_SETS} SELECT episode_id, {rnd('1-common_ticks/all_ticks', 4)} AS jer FROM j"
_REPORT = (
    edit_ctes(
        f"SELECT {{'clip': episode_id, 'asr': tool}} AS k, flatten(list({norm_words('ref_text')} ORDER BY seg_id)) AS ref,"
        f" flatten(list({norm_words('hyp_text')} ORDER BY seg_id)) AS hyp FROM hyp_tools GROUP BY episode_id, tool"
    )
    + f""",
 wer_of AS (SELECT k.clip AS clip, k.asr AS asr, {rnd('num_errors/num_words*100', 2)} AS wer FROM counts),
 der_of AS (SELECT episode_id AS clip, 'dia_a' AS dia, der_pct AS der FROM ({_der_sql('turn')}) UNION ALL SELECT episode_id, 'dia_b', der_pct FROM ({_der_sql('turn_ovl')})),
 jer_of AS (SELECT episode_id AS clip, 'dia_a' AS dia, jer FROM ({_JER.replace('turn_ovl', 'turn')}) UNION ALL SELECT episode_id, 'dia_b', jer FROM ({_JER})),
 mean_rtf AS (SELECT CASE stage WHEN 'asr' THEN 'asr' ELSE 'dia' END||CASE WHEN event_id%4<2 THEN '_a' ELSE '_b' END AS tool, avg(rtf) AS x FROM runtime GROUP BY 1),
 rtf_of AS (SELECT tool, {rnd('x', 4)} AS rtf FROM mean_rtf),
 report AS (SELECT g.clip, asr, dia, {rnd('g.duration_ms/1000', 2)} AS duration, wer, der, jer, coalesce(a.rtf, 0.0) AS rtf_asr, coalesce(d.rtf, 0.0) AS rtf_dia
  FROM (SELECT episode_id AS clip, duration_ms, unnest(['asr_a', 'asr_b']) AS asr FROM duration) g CROSS JOIN (SELECT unnest(['dia_a', 'dia_b']) AS dia) x
  LEFT JOIN wer_of USING (clip, asr) LEFT JOIN der_of USING (clip, dia) LEFT JOIN jer_of USING (clip, dia) LEFT JOIN rtf_of a ON a.tool=asr LEFT JOIN rtf_of d ON d.tool=dia)"""
)
_REPORT_VIEWS = "hyp_tools ref_turn turn turn_ovl duration runtime"


@query("eval_report", "E30 E13 E17 E18 E10 D13", "SELECT * FROM report", _REPORT_VIEWS, _REPORT, True)
def eval_report(t):
    """Whole texts, diarization and run times of two recognisers by two diarizers."""
    return _report(t)


_TEXT = ", ".join(f"coalesce({c}::VARCHAR, 'N/A') AS {c}" for c in "clip asr dia duration wer der jer rtf_asr rtf_dia".split())


@query("eval_summary", "B8", f"SELECT {_TEXT}, 'N/A' AS cpwer, NULL::VARCHAR AS notes FROM report", _REPORT_VIEWS, _REPORT, True)
def eval_summary(t):
    """The summary as a CSV file with its header, read back as text (an empty cell is null)."""
    path = scratch_path(t.spark, "eval-summary")
    table = S.eval_summary(_report(t))
    write_csv(table, path)
    return t.spark.read.option("header", True).schema(", ".join(f"{c} string" for c in table.columns)).csv(path)
