"""Queries on time joins, speaker mix, turns and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import analytics as N
from ..operators import masks as M
from ..operators import transcript as T
from .registry import query
from .sqltext import ts


@query("speaking_time", "E19 D1 E1 E2 M1 M2", """SELECT episode_id, speaker, dur_ms, word_count, segment_count, pct FROM speaking""", "speaking")
def speaking_time(t):
    return N.speaking_time(t.spoken)


@query("align_midpoint", "D1 M6", """SELECT * FROM aligned""", "aligned")
def align_midpoint(t):
    return t.aligned


@query("align_midpoint_overlapping", "D1", """SELECT w.episode_id, w.seg_id, w.word_idx, coalesce(t.speaker,'Unknown') AS speaker
  FROM word w LEFT JOIN turn_ovl t ON w.episode_id=t.episode_id AND 2*t.start_ms <= w.start_ms+w.end_ms AND w.start_ms+w.end_ms < 2*t.end_ms
  QUALIFY row_number() OVER (PARTITION BY w.episode_id, w.seg_id, w.word_idx ORDER BY t.start_ms, t.end_ms, t.turn_id)=1""", "word turn_ovl")
def align_midpoint_overlapping(t):
    return A.align_midpoint(t.plain_word, t.turn_ovl).select("episode_id", "seg_id", "word_idx", "speaker")


@query("align_midpoint_tolerance", "D1", """SELECT episode_id, seg_id, word_idx, CASE WHEN dist<=3000 THEN speaker ELSE 'Unknown' END AS speaker FROM (
  SELECT w.episode_id, w.seg_id, w.word_idx, t.speaker, t.start_ms AS ts,
   CASE WHEN 2*t.start_ms <= w.start_ms+w.end_ms AND w.start_ms+w.end_ms < 2*t.end_ms THEN -1
    WHEN w.start_ms+w.end_ms < 2*t.start_ms THEN 2*t.start_ms-(w.start_ms+w.end_ms) ELSE (w.start_ms+w.end_ms)-2*t.end_ms END AS dist
  FROM word w JOIN turn t ON w.episode_id=t.episode_id)
  QUALIFY row_number() OVER (PARTITION BY episode_id, seg_id, word_idx ORDER BY dist, ts)=1""", "word turn")
def align_midpoint_tolerance(t):
    return A.align_midpoint(t.plain_word, t.turn, tolerance_ms=1500).select("episode_id", "seg_id", "word_idx", "speaker")


_OVL = """SELECT w.episode_id, w.seg_id, w.word_idx, w.word, w.start_ms, w.end_ms, w.prob,
  CASE WHEN count(t.turn_id)=0 THEN 'UNKNOWN' WHEN count(*) FILTER (ov=mx)>1 THEN 'UNK' ELSE max(t.speaker) FILTER (ov=mx) END AS speaker
  FROM word w LEFT JOIN (SELECT w.episode_id, w.seg_id, w.word_idx, t.turn_id, t.speaker,
    least(w.end_ms+50,t.end_ms)-greatest(w.start_ms-50,t.start_ms) AS ov,
    max(least(w.end_ms+50,t.end_ms)-greatest(w.start_ms-50,t.start_ms)) OVER (PARTITION BY w.episode_id, w.seg_id, w.word_idx) AS mx
    FROM word w JOIN turn_ovl t ON w.episode_id=t.episode_id AND w.start_ms-50<t.end_ms AND t.start_ms<w.end_ms+50) t
  ON w.episode_id=t.episode_id AND w.seg_id=t.seg_id AND w.word_idx=t.word_idx GROUP BY ALL"""


@query("align_overlap", "D2 M16", _OVL, "word turn_ovl")
def align_overlap(t):
    return A.align_overlap(t.plain_word, t.turn_ovl)


@query("align_overlap_strict", "D2", f"SELECT * FROM ({_OVL}) WHERE speaker<>'UNKNOWN'", "word turn_ovl")
def align_overlap_strict(t):
    return A.align_overlap(t.plain_word, t.turn_ovl, strict=True)


@query("best_overlap", "D3", """SELECT a.episode_id, a.ord, s.seg_id, s.ov AS overlap_ms FROM assign a LEFT JOIN (
   SELECT a.episode_id, a.ord, s.seg_id, least(a.end_ms,s.end_ms)-greatest(a.start_ms,s.start_ms) AS ov
   FROM assign a JOIN seg s ON a.episode_id=s.episode_id AND a.start_ms<s.end_ms AND s.start_ms<a.end_ms AND a.start_ms<a.end_ms
   AND least(a.end_ms,s.end_ms)>greatest(a.start_ms,s.start_ms)
   QUALIFY row_number() OVER (PARTITION BY a.episode_id, a.ord ORDER BY ov DESC, s.seg_id)=1) s USING (episode_id, ord)""", "assign seg")
def best_overlap(t):
    return A.best_overlap(t.assign, t.seg.drop("ws"), ["seg_id"], "seg_id").select(
        "episode_id", "ord", F.col("best.seg_id").alias("seg_id"), "overlap_ms"
    )


@query("near_match", "D4", """SELECT a.episode_id, a.ord, t.turn_id FROM assign a JOIN turn t ON a.episode_id=t.episode_id
  AND abs(a.start_ms-t.start_ms)<150 AND abs(a.end_ms-t.end_ms)<150""", "assign turn")
def near_match(t):
    return A.near_match(t.assign, t.turn, ["turn_id"], tol_ms=150).select("episode_id", "ord", F.col("b_turn_id").alias("turn_id"))


@query("overlapped_speech", "D20", """SELECT a.episode_id, a.turn_id AS a_turn, b.turn_id AS b_turn, a.speaker AS a_speaker, b.speaker AS b_speaker,
  least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms) AS overlap_ms FROM turn_ovl a JOIN turn_ovl b ON a.episode_id=b.episode_id
  AND a.turn_id<b.turn_id AND a.speaker<>b.speaker AND least(a.end_ms,b.end_ms)>greatest(a.start_ms,b.start_ms)""", "turn_ovl")
def overlapped_speech(t):
    return A.overlapped_speech(t.turn_ovl)


@query("overlap_totals", "D20", """SELECT episode_id, least(x, y) AS a_speaker, greatest(x, y) AS b_speaker, sum(o)::BIGINT AS overlap_ms FROM (
  SELECT a.episode_id, a.speaker AS x, b.speaker AS y, least(a.end_ms,b.end_ms)-greatest(a.start_ms,b.start_ms) AS o FROM turn_ovl a JOIN turn_ovl b ON a.episode_id=b.episode_id
  AND a.turn_id<b.turn_id AND a.speaker<>b.speaker AND least(a.end_ms,b.end_ms)>greatest(a.start_ms,b.start_ms)) GROUP BY ALL""", "turn_ovl")
def overlap_totals(t):
    return A.overlap_totals(t.turn_ovl)


@query("speaker_mix", "E1", "SELECT * FROM mix", "mix")
def speaker_mix(t):
    return T.speaker_mix(t.aligned)


@query("dominant_speaker", "E2", """SELECT episode_id, seg_id, speaker, round(speaker_conf,6) AS speaker_conf, round(asr_conf,6) AS asr_conf, n_words FROM dom""", "dom")
def dominant_speaker(t):
    d = T.dominant_speaker(t.aligned)
    return d.withColumn("speaker_conf", F.round("speaker_conf", 6)).withColumn("asr_conf", F.round("asr_conf", 6))


@query("dominant_speaker_by_words", "E2", """SELECT a.episode_id, a.seg_id, coalesce(m.speaker,'Unknown') AS speaker, round(a.asr_conf,6) AS speaker_conf
  FROM dom a LEFT JOIN (SELECT * FROM mix QUALIFY row_number() OVER (PARTITION BY episode_id, seg_id ORDER BY n_words DESC, first_idx)=1) m
  USING (episode_id, seg_id)""", "dom mix")
def dominant_speaker_by_words(t):
    return T.dominant_speaker(t.aligned, prefer_longer=False).select(
        "episode_id", "seg_id", "speaker", F.round("speaker_conf", 6).alias("speaker_conf")
    )


@query("alignment_summary", "E3 M7", """SELECT s.episode_id, s.asr_segments, coalesce(t.turns,0) AS turns, coalesce(w.n,0) AS words_aligned,
  coalesce(w.u,0) AS unaligned, coalesce(p.speakers,'') AS speakers FROM (SELECT episode_id, count(*) AS asr_segments FROM seg GROUP BY 1) s
  LEFT JOIN (SELECT episode_id, count(*) AS turns FROM turn GROUP BY 1) t USING (episode_id)
  LEFT JOIN (SELECT episode_id, count(*) AS n, count(*) FILTER (speaker='Unknown') AS u FROM aligned GROUP BY 1) w USING (episode_id)
  LEFT JOIN (SELECT episode_id, string_agg(speaker, ',' ORDER BY f) AS speakers FROM (
    SELECT episode_id, speaker, min(seg_id*1000000+first_idx) AS f FROM mix GROUP BY ALL) GROUP BY 1) p USING (episode_id)""", "seg turn aligned mix")
def alignment_summary(t):
    return T.alignment_summary(t.seg, t.aligned, t.turn)


@query("speaker_order", "E4", """SELECT episode_id, speaker, min(seg_id) AS first_ord,
  row_number() OVER (PARTITION BY episode_id ORDER BY min(seg_id), speaker)-1 AS position FROM seg GROUP BY episode_id, speaker""", "seg")
def speaker_order(t):
    return T.first_heard(t.seg)


@query("transcript_summary", "E5 M8", """SELECT s.episode_id, s.segment_count, s.total_duration_ms, p.o AS speaker_order FROM
  (SELECT episode_id, count(*) AS segment_count, sum(end_ms-start_ms)::BIGINT AS total_duration_ms FROM seg GROUP BY 1) s
  JOIN (SELECT episode_id, string_agg(speaker, ',' ORDER BY f) AS o FROM (SELECT episode_id, speaker, min(seg_id) AS f FROM seg GROUP BY ALL) GROUP BY 1) p
  USING (episode_id)""", "seg")
def transcript_summary(t):
    return T.transcript_summary(t.seg)


@query("speaker_counts", "E8", "SELECT episode_id, speaker, count(*) AS segments FROM spoken GROUP BY ALL", "spoken")
def speaker_counts(t):
    return T.speaker_counts(t.spoken)


@query("turn_order", "G1 M4", """SELECT episode_id, turn_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id)-1 AS position FROM turn_ovl""", "turn_ovl")
def turn_order(t):
    from ..functions.intervals import SCAN_MS, floor_div
    from ..functions.ordered import prefix_scan

    return prefix_scan(
        t.turn_ovl.select("episode_id", "turn_id", "start_ms", "end_ms"), ["episode_id"], ["start_ms", "end_ms", "turn_id"],
        floor_div(F.col("start_ms"), SCAN_MS), sums={"position": F.lit(1).cast("bigint")},
    ).select("episode_id", "turn_id", "position")


@query("merge_turns", "F2", """SELECT episode_id, g AS turn_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM (
  SELECT *, sum(n) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_id, word_idx)::BIGINT AS g FROM (
   SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_id, word_idx) <> speaker THEN 1 ELSE 0 END AS n FROM aligned))
  GROUP BY ALL""", "aligned")
def merge_turns(t):
    return T.merge_turns(t.aligned)


@query("turn_text", "F2 C23", """SELECT episode_id, g AS turn_id, speaker, start_ms//600000 AS part, string_agg(word,' ' ORDER BY start_ms, seg_id, word_idx) AS text FROM (
  SELECT *, sum(n) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_id, word_idx)::BIGINT AS g FROM (
   SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_id, word_idx) <> speaker THEN 1 ELSE 0 END AS n FROM aligned))
  GROUP BY ALL""", "aligned")
def turn_text(t):
    return T.turn_text(t.aligned)


@query("labels_to_turns", "F3", """SELECT episode_id, g AS turn_id, label AS speaker,
  CASE WHEN g=0 THEN greatest(min(t_ms)-200,0) ELSE min(t_ms)-200 END AS start_ms, max(t_ms)+200 AS end_ms, count(*) AS n_frames FROM (
  SELECT *, sum(n) OVER (PARTITION BY episode_id ORDER BY t_ms)::BIGINT AS g FROM (
   SELECT *, CASE WHEN lag(label) OVER (PARTITION BY episode_id ORDER BY t_ms) <> label THEN 1 ELSE 0 END AS n FROM frame))
  GROUP BY episode_id, g, label""", "frame")
def labels_to_turns(t):
    return T.labels_to_turns(t.frame, 400)


@query("sliding_windows", "F7", """SELECT episode_id, k AS window_id, count(*) AS n_frames, round(avg(rms_db),6) AS mean_rms_db, k*750+750 AS mid_ms FROM (
  SELECT f.*, e.m, unnest(range(greatest(ceil((t_ms-1499)/750.0),0)::BIGINT, t_ms//750+1)) AS k
  FROM frame f JOIN (SELECT episode_id, max(t_ms) AS m FROM frame GROUP BY 1) e USING (episode_id))
  WHERE k*750+1500 <= m+1 GROUP BY ALL""", "frame")
def sliding_windows(t):
    return T.sliding_windows(t.frame).withColumn("mean_rms_db", F.round("mean_rms_db", 6))


@query("turn_stats", "E22", """SELECT episode_id, count(*) AS segments, count(*) FILTER (was<>speaker) AS changes, round(avg(end_ms-start_ms),6) AS avg_ms,
  min(end_ms-start_ms) AS min_ms, max(end_ms-start_ms) AS max_ms, round(count(*)/(count(*) FILTER (was<>speaker)+1),6) AS per_turn FROM (
  SELECT *, lag(speaker) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id) AS was FROM turn_ovl) GROUP BY 1""", "turn_ovl")
def turn_stats(t):
    return N.turn_stats(t.turn_ovl)


@query("speaker_shares", "E22", """SELECT episode_id, speaker, dur_ms, segments, round(dur_ms/max(m) OVER (PARTITION BY episode_id),6) AS share FROM (
  SELECT episode_id, speaker, sum(end_ms-start_ms)::BIGINT AS dur_ms, count(*) AS segments, max(end_ms) AS m FROM turn_ovl GROUP BY ALL)""", "turn_ovl")
def speaker_shares(t):
    return N.speaker_shares(t.turn_ovl)


@query("speaker_transitions", "F10", """SELECT speaker AS from_speaker, nx AS to_speaker, count(*) AS n, sum(greatest(ns-end_ms,0))::BIGINT AS gap_ms,
  sum(greatest(end_ms-ns,0))::BIGINT AS overlap_ms, count(*) FILTER (ns<end_ms) AS n_overlaps FROM (
  SELECT *, lead(speaker) OVER w AS nx, lead(start_ms) OVER w AS ns FROM turn_ovl WINDOW w AS (PARTITION BY episode_id ORDER BY start_ms, end_ms, turn_id))
  WHERE nx IS NOT NULL GROUP BY ALL""", "turn_ovl")
def speaker_transitions(t):
    return N.speaker_transitions(t.turn_ovl)


@query("talk_ranking", "G7", """SELECT speaker, sum(dur_ms)::BIGINT AS total_ms, count(DISTINCT episode_id) AS episodes FROM speaking GROUP BY 1""", "speaking")
def talk_ranking(t):
    return N.talk_ranking(N.speaking_time(t.spoken))


_SHOWS = '''SELECT *, 'show'||(episode_id%5) AS "show", (episode_id//5)%4 AS season FROM speaking'''


def _with_show(t):
    return N.speaking_time(t.spoken).withColumn("show", F.concat(F.lit("show"), (F.col("episode_id") % 5).cast("string"))).withColumn(
        "season", F.floor(F.col("episode_id") / 5) % 4
    )


@query("cross_episode", "E23", f"""SELECT "show", season, episode_id, speaker, sum(dur_ms)::BIGINT AS dur_ms, sum(word_count)::BIGINT AS word_count,
  sum(segment_count)::BIGINT AS segment_count, grouping("show", season, episode_id, speaker) AS level FROM ({_SHOWS})
  GROUP BY ROLLUP("show", season, episode_id, speaker)""", "speaking")
def cross_episode(t):
    return N.cross_episode(_with_show(t))


@query("speaker_seasons", "E23", f"""SELECT speaker, "show", season, sum(dur_ms)::BIGINT AS dur_ms, count(DISTINCT episode_id) AS episodes FROM ({_SHOWS})
  GROUP BY GROUPING SETS ((speaker),(speaker,"show"),(speaker,"show",season))""", "speaking")
def speaker_seasons(t):
    return N.speaker_seasons(_with_show(t))


@query("first_appearance", "F11", "SELECT speaker, min(episode_id) AS first_episode FROM speaking GROUP BY 1", "speaking")
def first_appearance(t):
    return N.first_appearance(t.spoken)


@query("asr_summary", "E24", """SELECT w.*, round(r.a,6) AS asr_s, round(r.d,6) AS diarization_s FROM (SELECT episode_id, count(DISTINCT seg_id) AS segment_count,
  count(*) AS word_count, round(avg(prob),6) AS mean_conf FROM word GROUP BY 1) w LEFT JOIN (SELECT clip AS episode_id,
  sum(duration_s) FILTER (stage='asr') AS a, sum(duration_s) FILTER (stage='diarization') AS d FROM runtime GROUP BY 1) r USING (episode_id)""", "word runtime")
def asr_summary(t):
    out = N.asr_summary(t.word, t.runtime.withColumnRenamed("clip", "episode_id"))
    return out.withColumn("asr_s", F.round("asr_s", 6)).withColumn("diarization_s", F.round("diarization_s", 6))


# --- masks -----------------------------------------------------------------


@query("merge_masks", "F8", """SELECT episode_id, type, start_ms, end_ms, members, conf FROM (
  SELECT episode_id, type, g, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members, max(conf) AS conf FROM (
   SELECT *, sum(n) OVER (PARTITION BY episode_id, type ORDER BY start_ms, end_ms, mask_id) AS g FROM (
    SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY episode_id, type ORDER BY start_ms, end_ms, mask_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS n FROM mask)) GROUP BY ALL)
  WHERE members>1 OR end_ms-start_ms>=80""", "mask")
def merge_masks(t):
    return M.merge_masks(t.mask)


_MARK = """SELECT *, CASE WHEN label IS NOT NULL AND trail-rms_db>=20 AND least(1.0, 0.5+(trail-rms_db)/80)>=0.7 THEN 'mute'
   WHEN centroid_hz BETWEEN 800 AND 2500 AND flatness<=0.2 AND rms_db+60>=10 AND 1-flatness>=0.7 THEN 'tone'
   WHEN flatness>=0.6 AND rms_db+60>=10 AND flatness>=0.7 THEN 'noise' ELSE 'none' END AS kind FROM (
  SELECT *, avg(rms_db) OVER (PARTITION BY episode_id ORDER BY t_ms RANGE BETWEEN 2000 PRECEDING AND 1 PRECEDING) AS trail FROM frame)"""


@query("detect_masks", "F9", f"""WITH m AS ({_MARK}), e AS (SELECT episode_id, kind AS type, greatest(min(t_ms)-200,0)::BIGINT AS start_ms, (max(t_ms)+200)::BIGINT AS end_ms, g
   FROM (SELECT *, sum(n) OVER (PARTITION BY episode_id ORDER BY t_ms) AS g FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY episode_id ORDER BY t_ms)=kind THEN 0 ELSE 1 END AS n FROM m))
   WHERE kind<>'none' GROUP BY episode_id, kind, g)
  SELECT episode_id, type, start_ms, end_ms, members FROM (SELECT episode_id, type, c, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM (
   SELECT *, sum(n) OVER (PARTITION BY episode_id, type ORDER BY start_ms, end_ms, g) AS c FROM (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY episode_id, type
     ORDER BY start_ms, end_ms, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS n FROM e)) GROUP BY episode_id, type, c)
  WHERE (members>1 OR end_ms-start_ms>=80) AND (type='mute' OR end_ms-start_ms<=1000)""", "frame")
def detect_masks(t):
    return M.detect_masks(t.frame, 400).drop("conf")


@query("attribute_masks", "D17", """SELECT m.mask_id, m.episode_id, t.speaker, t.ov AS overlap_ms FROM mask m LEFT JOIN (
  SELECT m.mask_id, t.speaker, least(m.end_ms,t.end_ms)-greatest(m.start_ms,t.start_ms) AS ov FROM mask m JOIN turn t ON m.episode_id=t.episode_id
  AND least(m.end_ms,t.end_ms)>greatest(m.start_ms,t.start_ms) QUALIFY row_number() OVER (PARTITION BY m.mask_id ORDER BY ov DESC, t.turn_id)=1) t USING (mask_id)""", "mask turn")
def attribute_masks(t):
    return A.attribute_masks(t.mask, t.turn).select("mask_id", "episode_id", "speaker", "overlap_ms")


@query("split_masks", "D18", """WITH c AS (SELECT m.mask_id, greatest(m.start_ms,t.start_ms) AS piece_start, least(m.end_ms,t.end_ms) AS piece_end, t.speaker
   FROM mask m JOIN turn t ON m.episode_id=t.episode_id AND least(m.end_ms,t.end_ms)>greatest(m.start_ms,t.start_ms)),
  b AS (SELECT mask_id, start_ms AS p FROM mask UNION SELECT mask_id, end_ms FROM mask UNION SELECT mask_id, piece_start FROM c UNION SELECT mask_id, piece_end FROM c),
  x AS (SELECT mask_id, p AS piece_start, lead(p) OVER (PARTITION BY mask_id ORDER BY p) AS piece_end FROM b)
  SELECT x.mask_id, x.piece_start, x.piece_end, c.speaker FROM x LEFT JOIN c ON x.mask_id=c.mask_id AND x.piece_start>=c.piece_start AND x.piece_end<=c.piece_end
  WHERE x.piece_end > x.piece_start""", "mask turn")
def split_masks(t):
    return A.split_masks(t.mask, t.turn).select("mask_id", "piece_start", "piece_end", "speaker")


@query("mask_sentence", "D19", """SELECT m.mask_id, s.seg_id AS sentence_seg, s.text AS sentence_text, '[BLEEP]' AS word_label FROM mask m LEFT JOIN (
  SELECT m.mask_id, s.seg_id, s.text FROM mask m JOIN seg s ON m.episode_id=s.episode_id AND least(m.end_ms,s.end_ms)>greatest(m.start_ms,s.start_ms)
  QUALIFY row_number() OVER (PARTITION BY m.mask_id ORDER BY least(m.end_ms,s.end_ms)-greatest(m.start_ms,s.start_ms) DESC, s.seg_id)=1) s USING (mask_id)""", "mask seg")
def mask_sentence(t):
    return A.mask_sentence(t.mask, t.seg.drop("ws")).select("mask_id", "sentence_seg", "sentence_text", "word_label")


@query("mask_table", "B7", f"""SELECT '[BLEEP]' AS "WORD", 'Person '||m.person_id AS "PERSON", {ts('m.start_ms')} AS "TIMESTAMP", coalesce(s.text,'') AS "SENTENCE USED IN"
  FROM mask m LEFT JOIN (SELECT m.mask_id, s.text FROM mask m JOIN seg s ON m.episode_id=s.episode_id AND least(m.end_ms,s.end_ms)>greatest(m.start_ms,s.start_ms)
  QUALIFY row_number() OVER (PARTITION BY m.mask_id ORDER BY least(m.end_ms,s.end_ms)-greatest(m.start_ms,s.start_ms) DESC, s.seg_id)=1) s USING (mask_id)""", "mask seg")
def mask_table(t):
    from ..session import scratch_path
    from ..sources.writers import write_csv

    rows = A.mask_sentence(t.mask, t.seg.drop("ws")).withColumn("person", F.concat(F.lit("Person "), F.col("person_id").cast("string")))
    path = scratch_path(t.spark, "masks")
    # Line breaks inside a sentence survive as quoted CSV fields.
    write_csv(M.mask_table(rows), path)
    return t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0001").schema(
        "WORD string, PERSON string, TIMESTAMP string, `SENTENCE USED IN` string"
    ).csv(path)


@query("match_sfx", "D22", """WITH p AS (SELECT type, freq_hz//100 AS band, avg(freq_hz) AS center, avg(end_ms-start_ms) AS avg_ms, type||'_'||(freq_hz//100) AS profile FROM mask GROUP BY ALL)
  SELECT m.mask_id, x.profile FROM mask m LEFT JOIN (SELECT m.mask_id, p.profile FROM mask m JOIN p ON m.type=p.type AND abs(m.freq_hz-p.center)<=100
   QUALIFY row_number() OVER (PARTITION BY m.mask_id ORDER BY round(abs(m.freq_hz-p.center)/100 + abs((m.end_ms-m.start_ms)-p.avg_ms)/greatest(p.avg_ms,1),9), p.profile)=1) x USING (mask_id)""", "mask")
def match_sfx(t):
    return M.match_sfx(t.mask, M.learn_sfx(t.mask)).select("mask_id", "profile")


@query("mask_stats", "E20", """SELECT m.episode_id, level, value, n, CASE WHEN level='total' AND duration_ms>0 THEN round(n/(duration_ms/60000),6) END AS per_minute FROM (
  SELECT episode_id, 'total' AS level, '' AS value, count(*) AS n FROM mask GROUP BY 1 UNION ALL SELECT episode_id, 'type', type, count(*) FROM mask GROUP BY 1,3
  UNION ALL SELECT episode_id, 'person', person_id::VARCHAR, count(*) FROM mask GROUP BY 1,3) m LEFT JOIN duration USING (episode_id)""", "mask duration")
def mask_stats(t):
    return M.mask_stats(t.mask, t.duration)


@query("mask_timeline", "E21", "SELECT episode_id, start_ms//60000*60000 AS time_ms, count(*) AS value FROM mask GROUP BY ALL", "mask")
def mask_timeline(t):
    return M.mask_timeline(t.mask)


@query("mask_person_totals", "E31", "SELECT person_id, sum(end_ms-start_ms)::BIGINT AS total_ms, count(*) AS masks FROM mask GROUP BY 1", "mask")
def mask_person_totals(t):
    return M.mask_person_totals(t.mask)


@query("analytics_document", "B10", """SELECT s.episode_id, s.total_ms, s.n_speakers, b.n AS total_count FROM
  (SELECT episode_id, sum(dur_ms)::BIGINT AS total_ms, count(*) AS n_speakers FROM speaking GROUP BY 1) s
  LEFT JOIN (SELECT episode_id, count(*) AS n FROM mask GROUP BY 1) b USING (episode_id)""", "speaking mask")
def analytics_document(t):
    """The JSON document, read back: JSON text itself differs between engines."""
    docs = N.analytics_document(N.speaking_time(t.spoken), M.mask_stats(t.mask, t.duration))
    parsed = F.from_json(
        "document", "total_dialogue_duration double, speakers array<struct<name:string,duration_seconds:double>>, bleeps struct<total_count:bigint>"
    )
    return docs.withColumn("d", parsed).select(
        "episode_id", F.round(F.col("d.total_dialogue_duration") * 1000).cast("bigint").alias("total_ms"),
        F.size("d.speakers").cast("bigint").alias("n_speakers"), F.col("d.bleeps.total_count").alias("total_count"),
    )
