"""Queries on speaker vectors, clips and label application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as N
from ..operators import bank as B
from ..operators import ops_log as O
from .registry import query

HIGH, MEDIUM, LOW = 0.40, 0.33, 0.25

_LEVEL = "CASE WHEN {0}>=0.40 THEN 'high' WHEN {0}>=0.33 THEN 'medium' WHEN {0}>=0.25 THEN 'low' END"
_MATCH = """SELECT q.qid, b.emb_id, b.speaker_id, b.display_name, round(list_cosine_similarity(q.vec,b.vec),12) AS sim
  FROM {0} q, bank b QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY sim DESC, lower(b.display_name), b.created DESC)=1"""


@query("match_bank", "D9 C15 A8", f"""SELECT qid, round(sim,6) AS sim, {_LEVEL.format('sim')} AS level, CASE WHEN sim>=0.25 THEN speaker_id END AS speaker_id,
  CASE WHEN sim>=0.25 THEN display_name END AS display_name, CASE WHEN sim>=0.25 THEN emb_id END AS emb_id FROM ({_MATCH.format('query')})""", "query bank")
def match_bank(t):
    got = B.match_bank(t.query.select("qid", "vec"), t.bank, HIGH, MEDIUM, LOW)
    return got.withColumn("sim", F.round("sim", 6))


@query("confidence_level", "C15", f"SELECT event_id, {_LEVEL.format('(value/500)')} AS level FROM events")
def confidence_level(t):
    return t.raw("events").select("event_id", B.confidence_level(F.col("value") / 500, HIGH, MEDIUM, LOW).alias("level"))


@query("read_bank", "A8", """SELECT emb_id, speaker_id, lower(display_name) AS name_key, created FROM bank WHERE emb_id%6<>1""", "bank")
def read_bank(t):
    """A sixth of the stored vectors is malformed (one element short) and is skipped."""
    stored = t.bank.withColumn("vec", F.when(F.col("emb_id") % 6 == 1, F.slice("vec", 1, 63)).otherwise(F.col("vec")))
    return B.read_bank(stored, 64).select("emb_id", "speaker_id", "name_key", "created")


@query("valid_clusters", "E6", """SELECT episode_id, speaker AS cluster_id, count(*) AS segments, sum(greatest(end_ms-start_ms,0))::BIGINT AS dur_ms FROM cluster_turn
  GROUP BY ALL HAVING count(*)>=3 AND sum(greatest(end_ms-start_ms,0))>=1000""", "cluster_turn")
def valid_clusters(t):
    return B.valid_clusters(t.cluster_turn)


_POOL = """SELECT episode_id, cluster_id, i, avg(x) AS x FROM (SELECT episode_id, cluster_id, unnest(vec) AS x, unnest(range(0,len(vec))) AS i FROM query) GROUP BY ALL"""


@query("pool_vectors", "E7", f"SELECT episode_id, cluster_id, i AS pos, round(x,6) AS x FROM ({_POOL})", "query")
def pool_vectors(t):
    pooled = B.pool_vectors(t.query, ["episode_id", "cluster_id"])
    return pooled.select("episode_id", "cluster_id", F.posexplode("vec").alias("pos", "x")).select(
        "episode_id", "cluster_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x")
    )


@query("retain_newest", "F5", "SELECT emb_id, speaker_id FROM bank QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY created DESC)<=5", "bank")
def retain_newest(t):
    return B.retain_newest(t.bank, 5).select("emb_id", "speaker_id")


@query("retain_best", "F6", "SELECT emb_id, speaker_id FROM (SELECT emb_id, speaker_id, created, CASE WHEN emb_id%9<>2 THEN quality END AS quality FROM bank) QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY coalesce(quality,0) DESC, created)<=5", "bank")
def retain_best(t):
    some = t.bank.withColumn("quality", F.when(F.col("emb_id") % 9 != 2, F.col("quality")))
    return B.retain_best(some, 5).select("emb_id", "speaker_id")


_IDENT = f"""clusters AS (SELECT episode_id, speaker AS cluster_id, count(*) AS segments, sum(greatest(end_ms-start_ms,0))::BIGINT AS dur_ms FROM cluster_turn GROUP BY ALL
   HAVING count(*)>=3 AND sum(greatest(end_ms-start_ms,0))>=1000),
 pooled AS (SELECT episode_id||'/'||cluster_id AS qid, episode_id, cluster_id, list(x ORDER BY i) AS vec FROM ({_POOL}) GROUP BY ALL),
 best AS ({_MATCH.format('pooled')}),
 ident AS (SELECT c.episode_id, c.cluster_id, c.segments, c.dur_ms, CASE WHEN b.sim>=0.25 THEN round(b.sim,6) END AS similarity, {_LEVEL.format('b.sim')} AS confidence_level,
   CASE WHEN b.sim>=0.25 THEN replace(lower(b.display_name),' ','') ELSE lower('auto_'||c.episode_id||'_'||c.cluster_id) END AS speaker_key,
   CASE WHEN b.sim>=0.25 THEN b.display_name ELSE 'Unknown Speaker '||c.cluster_id END AS display_name, coalesce(b.sim<0.25,true) AS auto_registered
   FROM clusters c LEFT JOIN best b ON b.qid=c.episode_id||'/'||c.cluster_id)"""


def _identified(t, auto=True):
    got = B.identify(t.cluster_turn, t.query, t.bank, high=HIGH, medium=MEDIUM, low=LOW, auto_register=auto)
    return got.drop("notes").withColumn("similarity", F.round("similarity", 6))


@query("identify", "J4 M10", "SELECT * FROM ident", "cluster_turn query bank", _IDENT)
def identify(t):
    return _identified(t)


@query("assignment_notes", "J4 M10", """SELECT episode_id, cluster_id, CASE WHEN auto_registered THEN 'No speaker met the minimum similarity threshold; manual labeling required.'
  WHEN confidence_level IN ('medium','low') THEN 'Similarity '||printf('%.3f', similarity)||' classified as '||confidence_level||'; review recommended.' ELSE '' END AS notes FROM ident""", "cluster_turn query bank", _IDENT)
def assignment_notes(t):
    """What a reviewer reads; nobody is registered here."""
    got = B.identify(t.cluster_turn, t.query, t.bank, high=HIGH, medium=MEDIUM, low=LOW)
    return got.select("episode_id", "cluster_id", F.array_join("notes", "\n").alias("notes"))


_SHOWS = """SELECT q.qid, b.emb_id, round(list_cosine_similarity(q.vec,b.vec),12) AS sim FROM query q JOIN bank b ON b.emb_id%3=q.vec_id%3
  QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY sim DESC, lower(b.display_name), b.created DESC)=1"""


@query("match_bank_by_show", "D9", f"SELECT qid, round(sim,6) AS sim, CASE WHEN sim>=0 THEN emb_id END AS emb_id FROM ({_SHOWS})", "query bank")
def match_bank_by_show(t):
    """Vectors of three shows: a query meets its own show's vectors only."""
    asked = t.query.withColumn("show", F.col("vec_id") % 3)
    stored = t.bank.withColumn("show", F.col("emb_id") % 3)
    got = B.match_bank(asked.select("show", "qid", "vec"), stored, -1.0, -1.0, -1.0, by=("show",))
    return got.select("qid", F.round("sim", 6).alias("sim"), "emb_id")


@query("register_unmatched", "J3", "SELECT episode_id, cluster_id, speaker_key AS key, display_name, cluster_id AS aliases, true AS auto_registered FROM ident WHERE auto_registered", "cluster_turn query bank", _IDENT)
def register_unmatched(t):
    rows = _identified(t, auto=False).withColumn("speaker_id", F.col("speaker_key"))
    return B.register_unmatched(rows).withColumn("aliases", F.array_join("aliases", ","))


@query("identification_summary", "E12", "SELECT episode_id, count(*) FILTER (NOT auto_registered) AS matched, count(*) FILTER (auto_registered) AS unmatched FROM ident GROUP BY 1", "cluster_turn query bank", _IDENT)
def identification_summary(t):
    return B.identification_summary(_identified(t, auto=False))


@query("segment_counter", "E29", """SELECT p.key, (p.total_segments+coalesce(a.n,0))::BIGINT AS total_segments FROM profile p LEFT JOIN (
  SELECT speaker_key, sum(segments) AS n FROM ident WHERE NOT auto_registered GROUP BY 1) a ON a.speaker_key=p.key""", "cluster_turn query bank profile", _IDENT)
def segment_counter(t):
    return B.segment_counter(_identified(t, auto=False), t.profile)


@query("apply_assignments", "D10", """SELECT s.episode_id, s.turn_id, CASE WHEN i.speaker_key IS NOT NULL THEN i.display_name ELSE s.speaker END AS speaker,
  CASE WHEN i.speaker_key IS NOT NULL THEN s.speaker END AS original_speaker, round(coalesce(i.similarity, 0.5),6) AS speaker_conf
  FROM cluster_turn s LEFT JOIN ident i ON i.episode_id=s.episode_id AND i.cluster_id=s.speaker""", "cluster_turn query bank", _IDENT)
def apply_assignments(t):
    segs = t.cluster_turn.withColumn("speaker_conf", F.lit(0.5))
    got = B.apply_assignments(segs, _identified(t))
    return got.select("episode_id", "turn_id", "speaker", "original_speaker", F.round("speaker_conf", 6).alias("speaker_conf"))


def _mapping(t):
    return t.seg.select(F.col("speaker").alias("label")).distinct().select(
        "label", F.when(F.col("label") == "user", " Alice ").when(F.col("label") == "assistant", "Bob").otherwise("  ").alias("name")
    )


@query("apply_mapping", "D11", """SELECT episode_id, seg_id, CASE speaker WHEN 'user' THEN 'Alice' WHEN 'assistant' THEN 'Bob' ELSE speaker END AS speaker,
  CASE WHEN speaker IN ('user','assistant') THEN speaker END AS original_speaker, speaker IN ('user','assistant') AS manual_label,
  CASE WHEN speaker IN ('user','assistant') THEN speaker END AS mapping_from, CASE speaker WHEN 'user' THEN 'Alice' WHEN 'assistant' THEN 'Bob' END AS mapping_to FROM seg""", "seg")
def apply_mapping(t):
    return B.apply_mapping(t.seg.select("episode_id", "seg_id", "speaker"), _mapping(t))


@query("valid_assignments", "C33", """SELECT episode_id, ord, start_ms, end_ms, speaker FROM assign WHERE ord%4<>1 AND end_ms>start_ms""", "assign")
def valid_assignments(t):
    """Starts of every fourth row are not numeric."""
    raw = t.assign.withColumn("start_ms", F.when(F.col("ord") % 4 == 1, F.lit("soon")).otherwise(F.col("start_ms").cast("string")))
    return B.valid_assignments(raw.withColumn("end_ms", F.col("end_ms").cast("string")))


@query("assign_segments", "D12", """WITH hit AS (SELECT a.episode_id, s.seg_id, a.ord, a.speaker AS to_speaker FROM assign a JOIN seg s ON a.episode_id=s.episode_id AND a.end_ms>a.start_ms
   AND least(a.end_ms,s.end_ms)>greatest(a.start_ms,s.start_ms)
   QUALIFY row_number() OVER (PARTITION BY a.episode_id, a.ord ORDER BY least(a.end_ms,s.end_ms)-greatest(a.start_ms,s.start_ms) DESC, s.seg_id)=1),
  st AS (SELECT *, lag(to_speaker) OVER (PARTITION BY episode_id, seg_id ORDER BY ord) AS was FROM hit),
  ag AS (SELECT episode_id, seg_id, arg_max(to_speaker, ord) AS fin, arg_min(to_speaker, ord) AS fst, count(*) FILTER (was IS NOT NULL AND was<>to_speaker) AS ch FROM st GROUP BY ALL)
  SELECT s.episode_id, s.seg_id, coalesce(a.fin, s.speaker) AS speaker, CASE WHEN coalesce(a.ch,0)+CASE WHEN a.fst<>s.speaker THEN 1 ELSE 0 END>0 THEN s.speaker END AS original_speaker,
   (coalesce(a.ch,0)+CASE WHEN a.fst<>s.speaker THEN 1 ELSE 0 END)::BIGINT AS manual_count FROM seg s LEFT JOIN ag a USING (episode_id, seg_id)""", "assign seg")
def assign_segments(t):
    return B.assign_segments(t.seg.select("episode_id", "seg_id", "speaker", "start_ms", "end_ms"), t.assign).select(
        "episode_id", "seg_id", "speaker", "original_speaker", "manual_count"
    )


@query("upsert_profiles", "B12", """SELECT coalesce(p.key,c.key) AS key, CASE WHEN c.key IS NOT NULL THEN c.display_name ELSE p.display_name END AS display_name, p.total_segments,
  CASE WHEN c.key IS NOT NULL THEN NULL ELSE p.first_episode END AS first_episode FROM profile p FULL JOIN (
  SELECT lower('speaker'||(label+5)) AS key, 'Speaker '||(label+5) AS display_name FROM (SELECT DISTINCT label FROM vectors)) c ON p.key=c.key""", "profile vectors")
def upsert_profiles(t):
    """One change per stored vector: many changes per key, half of them to known profiles."""
    changes = t.vectors.select(
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("speaker"), (F.col("label") + 5).cast("string"))).alias("key"),
        F.concat(F.lit("Speaker "), (F.col("label") + 5).cast("string")).alias("display_name"),
        F.lit(None).cast("bigint").alias("first_episode"), F.col("vec_id").alias("ord"),
    )
    return B.upsert_profiles(t.profile, changes)


@query("orphans", "D21", "SELECT mask_id, episode_id FROM mask WHERE episode_id NOT IN (SELECT episode_id FROM seg)", "mask seg")
def orphans(t):
    return N.orphans(t.mask, t.seg, "episode_id", "episode_id").select("mask_id", "episode_id")


@query("orphans_set_null", "D21", "SELECT mask_id, CASE WHEN episode_id IN (SELECT episode_id FROM seg) THEN episode_id END AS episode_id FROM mask", "mask seg")
def orphans_set_null(t):
    return N.without_orphans(t.mask, t.seg, "episode_id", "episode_id", "set_null").select("mask_id", "episode_id")


# --- clips -------------------------------------------------------------------

_RMS = "sqrt(list_sum(list_transform(samples, lambda x: x*x))/len(samples))"
_PEAK = "list_max(list_transform(samples, lambda x: abs(x)))"


@query("clip_stats", "C24 M17", f"""SELECT clip_id, len(samples)/64.0 AS duration_s, round({_RMS},6) AS rms, CASE WHEN {_PEAK}>0 THEN round(20*log10({_PEAK}),6) END AS peak_dbfs,
  len(samples)>=64 AS duration_ok, coalesce({_PEAK}>0 AND 20*log10(greatest({_PEAK},1e-300))>=-10, false) AS peak_ok, {_RMS}>=0.0001 AS rms_ok FROM clip""", "clip")
def clip_stats(t):
    s = t.clip.withColumn("s", B.clip_stats(F.col("samples"), 64))
    return s.withColumn("g", B.clip_gates(F.col("s"), min_peak=-10.0)).select(
        "clip_id", "s.duration_s", F.round("s.rms", 6).alias("rms"), F.round("s.peak_dbfs", 6).alias("peak_dbfs"), "g.*"
    )


def _quality(x: str) -> str:
    mean = f"(list_sum({x})/len({x}))"
    ms = f"(list_sum(list_transform({x}, lambda x: x*x))/len({x}))"
    clipped = f"(len(list_filter({x}, lambda x: abs(x)>=0.99))/len({x}))"
    return (
        f"CASE WHEN len({x})=0 THEN 0.0 ELSE greatest(0.0, least(1.0, least(sqrt({ms})/0.1::DOUBLE,1.0)*0.4::DOUBLE + greatest(0.0,1-{clipped}*10)*0.4::DOUBLE"
        f" + least(sqrt(greatest({ms}-{mean}*{mean},0))/0.1::DOUBLE,1.0)*0.2::DOUBLE)) END"
    )


@query("clip_quality", "C25", f"SELECT clip_id, round({_quality('samples')},6) AS quality FROM clip", "clip")
def clip_quality(t):
    return t.clip.select("clip_id", F.round(B.clip_quality(F.col("samples")), 6).alias("quality"))


_TRIM = """(SELECT *, list_transform(samples, lambda x: abs(x)>pow(10,-30/20.0)) AS loud FROM clip)"""
_KEEP = """SELECT clip_id, speaker_id, samples, CASE WHEN list_position(loud,true)>0 AND (len(loud)+1-list_position(list_reverse(loud),true))-list_position(loud,true)>=40
  THEN samples[list_position(loud,true):(len(loud)+1-list_position(list_reverse(loud),true))] ELSE [] END AS kept FROM """ + _TRIM


@query("trim_silence", "C26", f"SELECT clip_id, len(kept)::BIGINT AS n, round(coalesce(list_sum(kept),0),6) AS total FROM ({_KEEP})", "clip")
def trim_silence(t):
    kept = B.trim_silence(F.col("samples"), -30.0, 40)
    return t.clip.withColumn("k", kept).select(
        "clip_id", F.size("k").cast("bigint").alias("n"),
        F.round(F.aggregate("k", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query("downsample", "C27", """SELECT clip_id, i AS pos, round(list_sum(samples[(i*step+1):(i*step+step)])/step,6) AS amp FROM (
  SELECT clip_id, samples, greatest(1,len(samples)//10) AS step, unnest(range(0,len(samples)//greatest(1,len(samples)//10))) AS i FROM clip)""", "clip")
def downsample(t):
    return t.clip.select("clip_id", F.posexplode(B.downsample(F.col("samples"), 10)).alias("pos", "amp")).select(
        "clip_id", F.col("pos").cast("bigint").alias("pos"), F.round("amp", 6).alias("amp")
    )


@query("embed_clips", "J1", """SELECT clip_id, round(list_sum(samples)/len(samples),6) AS mean, round(list_sum(list_transform(samples, lambda x: x*x))/len(samples),6) AS second FROM clip""", "clip")
def embed_clips(t):
    return B.embed_clips(t.clip).select("clip_id", F.round(F.col("vec")[0], 6).alias("mean"), F.round(F.col("vec")[1], 6).alias("second"))


@query("embed_clips_custom", "J1", """SELECT clip_id, round(list_sum(samples)/len(samples),6) AS mean, round(list_max(samples),6) AS top FROM clip""", "clip")
def embed_clips_custom(t):
    """The user hook: any function of one sample array, on Arrow batches."""
    got = B.embed_clips(t.clip, lambda x: [x.mean(), x.max()])
    return got.select("clip_id", F.round(F.col("vec")[0], 6).alias("mean"), F.round(F.col("vec")[1], 6).alias("top"))


_SIL = """SELECT clip_id, speaker_id, samples, CASE WHEN list_position(loud,true)>0 AND (len(loud)+1-list_position(list_reverse(loud),true))-list_position(loud,true)>=54
  THEN samples[list_position(loud,true):(len(loud)+1-list_position(list_reverse(loud),true))] ELSE [] END AS kept FROM (SELECT *, list_transform(samples, lambda x: abs(x)>pow(10,-40/20.0)) AS loud FROM clip)"""
_INGEST = f"""SELECT clip_id, speaker_id, CASE WHEN len(samples)/64.0<0.85 THEN 'too short' WHEN len(kept)=0 OR len(kept)/64.0<0.85 THEN 'silent' WHEN {_quality('kept')}<0.7 THEN 'low quality' END AS rejection_reason,
  {_quality('kept')} AS q FROM ({_SIL})"""


def _ingested(t):
    return B.ingest_clips(t.clip, 64, min_s=0.85, min_quality=0.7)


@query("ingest_clips", "J2 M11", f"""SELECT clip_id, speaker_id, rejection_reason, rejection_reason IS NULL AS accepted, CASE WHEN rejection_reason IN ('too short','silent') THEN NULL ELSE round(q,6) END AS quality FROM ({_INGEST})""", "clip")
def ingest_clips(t):
    return _ingested(t).select("clip_id", "speaker_id", "rejection_reason", "accepted", F.round("quality", 6).alias("quality"))


@query("grow_bank", "J2 F6", f"""SELECT emb_id, speaker_id FROM (SELECT emb_id, speaker_id, quality, created FROM bank UNION ALL
  SELECT clip_id+1000000, speaker_id, round(q,9), clip_id+1000000 FROM ({_INGEST}) WHERE rejection_reason IS NULL)
  QUALIFY row_number() OVER (PARTITION BY speaker_id ORDER BY coalesce(quality,0) DESC, created)<=20""", "clip bank")
def grow_bank(t):
    new = _ingested(t).withColumn("emb_id", F.col("clip_id") + 1000000).withColumn("created", F.col("emb_id")).withColumn("quality", F.round("quality", 9))
    return B.grow_bank(t.bank, new, 20).select("emb_id", "speaker_id")


@query("ingest_summary", "E11", f"""SELECT i.*, coalesce(b.n,0) AS bank_total FROM (SELECT speaker_id, count(*) FILTER (rejection_reason IS NULL) AS accepted, count(*) FILTER (rejection_reason IS NOT NULL) AS rejected
  FROM ({_INGEST}) GROUP BY 1) i LEFT JOIN (SELECT speaker_id, count(*) AS n FROM bank GROUP BY 1) b USING (speaker_id)""", "clip bank")
def ingest_summary(t):
    return O.ingest_summary(_ingested(t), t.bank)


@query("top_reasons", "G4", f"""SELECT speaker_id, rejection_reason, min(clip_id) AS first_ord, count(*) AS n, row_number() OVER (PARTITION BY speaker_id ORDER BY min(clip_id)) AS rn
  FROM ({_INGEST}) WHERE rejection_reason IS NOT NULL GROUP BY speaker_id, rejection_reason QUALIFY rn<=2""", "clip")
def top_reasons(t):
    return O.top_reasons(_ingested(t).withColumn("ord", F.col("clip_id")), 2)
