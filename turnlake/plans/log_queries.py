"""Queries on run logs, costs, metadata and sources of one episode."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as N
from ..operators import ops_log as O
from ..operators import scoring as S
from .registry import query
from .sqltext import edit_ctes, norm_words

_ROLL = """SELECT provider, model, round(sum(cost_usd),6) AS cost_usd, count(*) AS runs, round(sum(duration_s),6) AS duration_s, max(ts) AS last_used, arg_max(media_path, event_id) AS last_media
  FROM cost GROUP BY GROUPING SETS ((),(provider),(provider,model))"""


@query("cost_rollup", "E9 M12", _ROLL, "cost")
def cost_rollup(t):
    return O.cost_rollup(t.cost).withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


@query("runtime_stats", "E10 M13", """SELECT tool, stage, count(*) AS runs, round(sum(duration_s),6) AS total_s, round(avg(duration_s),6) AS mean_s, min(duration_s) AS min_s, max(duration_s) AS max_s,
  round(avg(rtf),6) AS mean_rtf, min(rtf) AS min_rtf, max(rtf) AS max_rtf FROM runtime GROUP BY ALL""", "runtime")
def runtime_stats(t):
    return O.runtime_stats(t.runtime)


@query("runtime_cube", "E10", "SELECT tool, stage, count(*) AS runs, round(sum(duration_s),6) AS total_s, round(avg(rtf),6) AS mean_rtf FROM runtime GROUP BY CUBE(tool, stage)", "runtime")
def runtime_cube(t):
    return O.runtime_cube(t.runtime)


@query("run_status", "E28 M3 M5", "SELECT status, count(*) AS runs, round(avg(epoch_us(ended)-epoch_us(started))/1e6,3) AS mean_elapsed_s FROM run GROUP BY 1", "run")
def run_status(t):
    return N.run_status(t.run)


_KEYS = ["signup", "click", "view", "purchase", "diarization"]


@query("stage_status", "C34", "SELECT episode_id, bool_or(key='signup') AS signup, bool_or(key='click') AS click, bool_or(key='view') AS \"view\", bool_or(key='purchase') AS purchase, bool_or(key='diarization') AS diarization FROM artifact GROUP BY 1", "artifact")
def stage_status(t):
    return N.stage_status(t.artifact, _KEYS)


@query("patch_metadata", "H5", """WITH c AS (SELECT episode_id, key, max(event_id)::VARCHAR AS v FROM artifact WHERE event_id%2=0 GROUP BY ALL),
  u AS (SELECT episode_id, key, CASE WHEN max(event_id)%3<>0 THEN 'new'||max(event_id) END AS v FROM artifact WHERE event_id%2=1 GROUP BY ALL)
  SELECT coalesce(c.episode_id,u.episode_id) AS episode_id, coalesce(c.key,u.key) AS key, CASE WHEN u.key IS NOT NULL THEN u.v ELSE c.v END AS value FROM c FULL JOIN u ON c.episode_id=u.episode_id AND c.key=u.key
  WHERE CASE WHEN u.key IS NOT NULL THEN u.v ELSE c.v END IS NOT NULL""", "artifact")
def patch_metadata(t):
    last = F.max("event_id")

    def side(rows, value):
        per = rows.groupBy("episode_id", "key").agg(value.alias("v"))
        m = per.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("artifacts"))
        empty = F.lit(None).cast("map<string,string>")
        return m.withColumn("fields", empty).withColumn("shared_artifacts", empty).withColumn("created_at", F.lit("2024-01-01"))

    current = side(t.artifact.filter("event_id % 2 = 0"), last.cast("string"))
    updates = side(t.artifact.filter("event_id % 2 = 1"), F.when(last % 3 != 0, F.concat(F.lit("new"), last.cast("string"))))
    return O.patch_metadata(current, updates).select("episode_id", F.explode("artifacts").alias("key", "value"))


def _dual(t):
    """The vocals pass exists for two of three episodes, the mix pass for all."""
    vocals = t.seg.filter("episode_id % 3 <> 2").select("episode_id", "seg_id", "text", F.lit("vocals").alias("source"))
    mix = t.hyp.select("episode_id", "seg_id", F.col("hyp_text").alias("text"), F.lit("mix").alias("source"))
    return vocals.unionByName(mix)


@query("dual_source", "H6", """SELECT episode_id, seg_id, CASE WHEN episode_id%3<>2 THEN ref_text ELSE hyp_text END AS text, CASE WHEN episode_id%3<>2 THEN 'vocals' ELSE 'mix' END AS source FROM hyp""", "hyp")
def dual_source(t):
    return O.dual_source(_dual(t)).select("episode_id", "seg_id", "text", "source")


@query("source_agreement", "H6", "SELECT k AS episode_id, round(sum(num_errors)/sum(num_words),6) AS wer FROM counts GROUP BY 1", "hyp",
       edit_ctes(f"SELECT episode_id AS k, {norm_words('ref_text')} AS ref, {norm_words('hyp_text')} AS hyp FROM hyp WHERE episode_id%3<>2"), True)
def source_agreement(t):
    both = _dual(t)
    v = both.filter("source = 'vocals'").select("episode_id", "seg_id", F.col("text").alias("ref_text"))
    m = both.filter("source = 'mix'").select("episode_id", "seg_id", F.col("text").alias("hyp_text"))
    counts = S.wer(v.join(m, ["episode_id", "seg_id"]), ["episode_id", "seg_id"])
    return S.corpus_wer(counts, ["episode_id"]).select("episode_id", F.round("wer", 6).alias("wer"))
