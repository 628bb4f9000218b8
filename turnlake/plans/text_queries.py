"""Queries on scalar formats, review rules and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ops_log as O
from ..operators import transcript as T
from .registry import query
from .sqltext import fixed2, ms2, norm_words, rnd, ts


@query("filter_words", "C1", """SELECT episode_id, seg_id, count(*) FILTER (prob>=0.5) AS kept, count(*) AS all_words FROM word GROUP BY ALL""", "word")
def filter_words(t):
    return t.aseg.select(
        "episode_id", "seg_id", F.size(T.filter_words(F.col("words"), 0.5)).cast("bigint").alias("kept"),
        F.size(T.filter_words(F.col("words"), None)).cast("bigint").alias("all_words"),
    )


@query("segment_confidence", "C2", """SELECT s.episode_id, s.seg_id, round(CASE WHEN s.seg_id%4=3 THEN exp(-s.nw/100.0) ELSE w.p END,6) AS conf
  FROM seg s JOIN (SELECT episode_id, seg_id, avg(prob) AS p FROM word GROUP BY ALL) w USING (episode_id, seg_id)""", "seg word")
def segment_confidence(t):
    """Every fourth segment has lost its words and falls back to exp(avg_logprob)."""
    words = F.when(F.col("seg_id") % 4 == 3, F.slice("words", 1, 0)).otherwise(F.col("words"))
    return t.aseg.select(
        "episode_id", "seg_id", F.round(T.segment_confidence(words, -F.col("nw") / 100), 6).alias("conf")
    )


@query("synthesise_words", "C3", """SELECT episode_id, seg_id, CASE WHEN seg_id%4=3 THEN text ELSE ws[1] END AS first_word, start_ms,
  CASE WHEN seg_id%4=3 THEN end_ms ELSE start_ms+400 END AS first_end, CASE WHEN seg_id%4=3 THEN 1 ELSE nw END::BIGINT AS n FROM seg""", "seg")
def synthesise_words(t):
    words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["prob"].alias("prob")))
    words = F.when(F.col("seg_id") % 4 == 3, F.slice(words, 1, 0)).otherwise(words)
    made = t.aseg.withColumn("w", T.synthesise_words(words, F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("asr_conf")))
    first = F.element_at("w", 1)
    return made.select("episode_id", "seg_id", first["word"].alias("first_word"), first["start_ms"].alias("start_ms"), first["end_ms"].alias("first_end"), F.size("w").cast("bigint").alias("n"))


@query("even_word_times", "C4", """SELECT episode_id, seg_id, i AS pos, w AS word, start_ms+(2*i*span+nw)//(2*nw) AS start_ms, start_ms+(2*(i+1)*span+nw)//(2*nw) AS end_ms
  FROM (SELECT episode_id, seg_id, start_ms, nw, nw*333+7 AS span, unnest(ws) AS w, unnest(range(0,nw)) AS i FROM seg)""", "seg")
def even_word_times(t):
    timed = T.even_word_times(F.col("text"), F.col("start_ms"), F.col("start_ms") + F.col("nw") * 333 + 7)
    return t.seg.select("episode_id", "seg_id", F.posexplode(timed).alias("pos", "w")).select(
        "episode_id", "seg_id", F.col("pos").cast("bigint").alias("pos"), "w.word", "w.start_ms", "w.end_ms"
    )


@query("split_sentences", "C5", r"""SELECT episode_id, seg_id, unnest(s) AS sentence, unnest(range(0,len(s))) AS pos FROM (
  SELECT episode_id, seg_id, list_filter(list_transform(regexp_split_to_array(text,'[.!?]+'), lambda x: regexp_replace(x,'^[ \t\n\r\f]+|[ \t\n\r\f]+$','','g')), lambda x: x<>'') AS s FROM seg)""", "seg")
def split_sentences(t):
    return t.seg.select("episode_id", "seg_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query("format_times", "C6 C7 C8 C11", f"""SELECT episode_id, turn_id, {ts('start_ms')} AS dotted, {ts('end_ms', ',')} AS comma,
  CASE WHEN start_ms%1000<>0 THEN ' ['||split_part({ts('start_ms')},'.',1)||']' ELSE '' END AS suffix, greatest(end_ms-start_ms,0) AS duration_ms,
  '00:00:00.000' AS clamped FROM turn_ovl""", "turn_ovl")
def format_times(t):
    s, e = F.col("start_ms"), F.col("end_ms")
    return t.turn_ovl.select(
        "episode_id", "turn_id", X.fmt_timestamp(s).alias("dotted"), X.fmt_timestamp(e, ",").alias("comma"),
        X.timestamp_suffix(s).alias("suffix"), F.greatest(e - s, F.lit(0)).alias("duration_ms"), X.fmt_timestamp(-s - 1).alias("clamped"),
    )


@query("fmt_duration", "C9", """SELECT event_id, CASE WHEN x<60 THEN printf('%.1fs',x) WHEN x<3600 THEN printf('%dm %.1fs',floor(x/60)::BIGINT,x-60*floor(x/60))
  ELSE printf('%dh %dm %.0fs',floor(x/3600)::BIGINT,(floor(x/60)::BIGINT)%60,x-60*floor(x/60)) END AS shown FROM (SELECT event_id, floor(value*17*4)/4+0.125 AS x FROM events)""")
def fmt_duration(t):
    x = F.floor(F.col("value") * 17 * 4) / 4 + 0.125
    return t.raw("events").select("event_id", X.fmt_duration(x).alias("shown"))


@query("normalise_segment", "C10", """SELECT episode_id, seg_id, CASE WHEN seg_id%5=0 THEN 0 ELSE start_ms END AS start_ms,
  CASE WHEN seg_id%5=0 THEN CASE WHEN seg_id%2=0 THEN 0 ELSE end_ms END WHEN seg_id%2=0 THEN start_ms ELSE end_ms END AS end_ms,
  CASE seg_id%3 WHEN 0 THEN 'named' WHEN 1 THEN speaker ELSE printf('SPEAKER_%02d', seg_id) END AS speaker, nw::BIGINT AS n_words FROM seg""", "seg")
def normalise_segment(t):
    """Unreadable numbers, missing speakers and words under either key, by rule."""
    i = F.col("seg_id")
    raw = t.seg.select(
        "episode_id", "seg_id",
        F.when(i % 5 == 0, F.lit("bad")).otherwise((F.col("start_ms") / 1000).cast("string")).alias("start"),
        F.when(i % 2 == 0, F.lit(None)).otherwise((F.col("end_ms") / 1000).cast("string")).alias("end"),
        F.when(i % 3 == 0, F.lit("named")).otherwise("").alias("speaker_name"),
        F.when(i % 3 == 1, F.col("speaker")).alias("speaker"), F.lit(None).cast("string").alias("speaker_label"),
        F.concat(F.lit("  "), F.col("text")).alias("text"),
        F.transform("ws", lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("token"), F.lit("x").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("0.5").alias("probability"))).alias("words"),
    )
    return T.normalise_segments(raw).select("episode_id", "seg_id", "start_ms", "end_ms", "speaker", F.size("words").cast("bigint").alias("n_words"))


@query("norm_name", "C12", r"""SELECT doc_id, regexp_replace(lower(strip_accents(replace(text,'ß','ss'))),'[^\p{L}\p{N}]','','g') AS norm FROM documents""")
def norm_name(t):
    return t.raw("documents").select("doc_id", X.norm_name(F.col("text")).alias("norm"))


@query("norm_key", "C13", r"SELECT nid, regexp_replace(lower(heard),'[^\p{L}\p{N}]','','g') AS key FROM heard", "heard")
def norm_key(t):
    return t.heard.select("nid", X.norm_key(F.col("heard")).alias("key"))


@query("norm_text", "C14", f"SELECT doc_id, array_to_string({norm_words('text')},' ') AS norm FROM documents")
def norm_text(t):
    return t.raw("documents").select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@query("match_case", "C16", """SELECT nid, CASE nid%4 WHEN 0 THEN upper(c) WHEN 1 THEN lower(c)
  WHEN 2 THEN array_to_string(list_transform(string_split(c,' '), lambda w: upper(w[1:1])||lower(w[2:])),' ') ELSE c END AS shown
  FROM (SELECT p_partkey AS nid, p_brand||' x' AS c FROM part)""")
def match_case(t):
    k = F.col("p_partkey") % 4
    original = F.when(k == 0, F.upper("p_name")).when(k == 1, F.lower("p_name")).when(k == 2, F.initcap("p_name")).otherwise(F.lit("miXed"))
    return t.raw("part").select(F.col("p_partkey").alias("nid"), X.match_case(original, F.concat("p_brand", F.lit(" x"))).alias("shown"))


_EP = "'The '||p_name||'_s'||(p_partkey%30)||'E'||lpad((p_partkey%99)::VARCHAR,2,'0')||CASE WHEN p_partkey%2=0 THEN '_ Cut-'||p_size ELSE '' END"


def _ep_text():
    return F.concat(
        F.lit("The "), "p_name", F.lit("_s"), (F.col("p_partkey") % 30).cast("string"), F.lit("E"),
        F.lpad((F.col("p_partkey") % 99).cast("string"), 2, "0"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_ Cut-"), F.col("p_size").cast("string"))).otherwise(""),
    )


@query("episode_code", "C17", f"""SELECT p_partkey AS nid, 'The '||p_name AS prefix, p_partkey%30 AS season, p_partkey%99 AS episode,
  CASE WHEN p_partkey%2=0 THEN 'Cut-'||p_size END AS variant FROM part""")
def episode_code(t):
    return t.raw("part").withColumn("c", X.episode_code(_ep_text())).select(
        F.col("p_partkey").alias("nid"), "c.prefix", F.col("c.season").cast("bigint").alias("season"),
        F.col("c.episode").cast("bigint").alias("episode"), "c.variant",
    )


@query("build_episode_id", "C18", """SELECT p_partkey AS nid, 'The'||array_to_string(list_transform(string_split(p_name,' '), lambda w: upper(w[1:1])||w[2:]),'')
  ||'_S'||lpad((p_partkey%30)::VARCHAR,2,'0')||'E'||lpad((p_partkey%99)::VARCHAR,2,'0')||CASE WHEN p_partkey%2=0 THEN '_cut' ELSE '' END AS episode FROM part""")
def build_episode_id(t):
    k = F.col("p_partkey")
    return t.raw("part").select(
        k.alias("nid"),
        X.build_episode_id(F.concat(F.lit("the "), "p_name"), k % 30, k % 99, F.when(k % 2 == 0, F.lit("cut")).otherwise("")).alias("episode"),
    )


@query("artifact_prefix", "C19", r"""SELECT o_orderkey, trim(regexp_replace(o_orderpriority,'[^A-Za-z0-9_-]+','_','g'),'_')||'_ep_'||o_orderkey||'_'||strftime(o_orderdate,'%Y%m%d') AS prefix,
  trim(regexp_replace(lower(o_orderpriority),'[^a-z0-9]+','_','g'),'_') AS slug FROM orders""")
def artifact_prefix(t):
    return t.raw("orders").select(
        "o_orderkey",
        X.artifact_prefix(F.col("o_orderpriority"), F.concat(F.lit("ep "), F.col("o_orderkey").cast("string")), F.col("o_orderdate")).alias("prefix"),
        X.slugify(F.col("o_orderpriority")).alias("slug"),
    )


@query("json_list_canon", "C20", """SELECT p_partkey AS nid, CASE WHEN p_partkey%10=7 THEN '' ELSE array_to_string(list_sort(list_distinct([p_name, p_brand])),'|') END AS shown FROM part""")
def json_list_canon(t):
    good = F.to_json(F.array("p_name", F.concat(F.lit(" "), "p_brand"), F.lit("  "), "p_name"))
    raw = F.when(F.col("p_partkey") % 10 == 7, F.lit("[broken")).otherwise(good)
    return t.raw("part").select(F.col("p_partkey").alias("nid"), F.array_join(X.json_list_canon(raw), "|").alias("shown"))


@query("rtf", "C21", f"SELECT event_id, CASE WHEN event_id%9<>0 THEN {rnd('duration_s/audio_s', 4)} END AS rtf FROM runtime", "runtime")
def rtf(t):
    audio = F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.col("audio_s"))
    return t.runtime.select("event_id", O.rtf(F.col("duration_s"), audio).alias("rtf"))


@query("estimate_cost", "C22", f"""SELECT episode_id, CASE WHEN x>0 THEN {rnd('x/60*0.006::DOUBLE', 4)} END AS cost_usd FROM (
  SELECT episode_id, CASE WHEN episode_id%3=0 THEN max(end_ms)/1000 WHEN episode_id%3=1 THEN 0 ELSE sum(nw)::DOUBLE END AS x FROM seg GROUP BY 1)""", "seg")
def estimate_cost(t):
    agg = t.seg.groupBy("episode_id").agg(F.max("end_ms").alias("last"), F.sum("nw").cast("double").alias("n"))
    k = F.col("episode_id") % 3
    return agg.select("episode_id", O.estimate_cost(F.when(k == 1, 0.0).when(k == 2, F.col("n")), F.col("last")).alias("cost_usd"))


@query("preprocess_decision", "C28", """SELECT event_id, (event_id%10)/10.0>0.3 OR (event_id%7)/7.0<0.6 AS separate, event_id%40<15 OR (event_id%11)/11.0>0.5 AS enhance, true AS separate_forced FROM events""")
def preprocess_decision(t):
    e = F.col("event_id")
    q = t.raw("events").select(
        "event_id", (e % 10 / 10).alias("music_ratio"), (e % 7 / 7).alias("speech_clarity"), (e % 40).alias("snr"), (e % 11 / 11).alias("reverb_score")
    )
    forced = O.preprocess_decision(q, separate=True).select("event_id", F.col("separate").alias("separate_forced"))
    return O.preprocess_decision(q).select("event_id", "separate", "enhance").join(forced, "event_id")


@query("review_queue", "C29 G5", """SELECT episode_id, seg_id FROM seg WHERE seg_id%3=1 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY seg_id)<=20""", "seg")
def review_queue(t):
    """Every third segment is still unlabelled."""
    some = t.seg.withColumn("speaker", F.when(F.col("seg_id") % 3 == 1, F.lit("Unknown Speaker 1")).otherwise(F.col("speaker")))
    return T.review_queue(some).select("episode_id", "seg_id")


@query("previews", "G5", """SELECT episode_id, turn_id FROM turn_ovl QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, turn_id)<=10""", "turn_ovl")
def previews(t):
    from ..functions.ordered import top_n

    return top_n(t.turn_ovl, ["episode_id"], [F.col("start_ms"), F.col("turn_id")], 10).select("episode_id", "turn_id")


_TRIM = """SELECT a.episode_id, a.seg_id, a.original, a.start_ms, a.end_ms, a.text, CASE WHEN coalesce(m.dur_ms,0)>0 THEN least(a.end_ms, a.start_ms+m.dur_ms) ELSE a.end_ms END AS trimmed_end
  FROM (SELECT *, CASE WHEN seg_id%6=5 THEN 'unknown' ELSE speaker END AS original FROM aseg) a LEFT JOIN mix m ON a.episode_id=m.episode_id AND a.seg_id=m.seg_id AND m.speaker=a.original"""


def _trimmed(t):
    labelled = t.aseg.withColumn(
        "original",
        T.original_label(F.lit(None).cast("string"), F.when(F.col("seg_id") % 6 == 5, F.lit("  ")).otherwise(F.col("speaker"))),
    )
    return T.trim_to_primary(labelled)


@query("trim_to_primary", "C30 C31", f"SELECT episode_id, seg_id, original, trimmed_end, trimmed_end<end_ms-50 AS trimmed FROM ({_TRIM})", "aseg mix")
def trim_to_primary(t):
    return _trimmed(t).select("episode_id", "seg_id", "original", "trimmed_end", "trimmed")


_KEPT = f"SELECT *, trimmed_end-start_ms AS dur FROM ({_TRIM}) WHERE trimmed_end>start_ms AND (trimmed_end-start_ms>=20000 OR trimmed_end<end_ms-50)"


@query("top_snippets", "G2", f"""SELECT episode_id, original, seg_id, dur AS dur_ms, row_number() OVER (PARTITION BY episode_id, original ORDER BY dur DESC, seg_id) AS rn FROM ({_KEPT})
  QUALIFY rn<=3""", "aseg mix")
def top_snippets(t):
    return T.top_snippets(_trimmed(t), 3, 20000).select("episode_id", "original", "seg_id", "dur_ms", F.col("rn").cast("bigint").alias("rn"))


@query("cluster_totals", "H7 G2", f"""SELECT episode_id, original, count(*) AS total_segments, sum(dur)::BIGINT AS total_ms, string_agg(seg_id::VARCHAR, ',' ORDER BY rn) FILTER (rn<=3) AS snippets
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, original ORDER BY dur DESC, seg_id) AS rn FROM ({_KEPT})) GROUP BY episode_id, original""", "aseg mix")
def cluster_totals(t):
    return T.cluster_totals(_trimmed(t), 3, 20000)


@query("first_segments", "G3", """SELECT episode_id, speaker AS original, seg_id FROM aseg QUALIFY row_number() OVER (PARTITION BY episode_id, speaker ORDER BY start_ms, seg_id)<=2""", "aseg")
def first_segments(t):
    return T.first_segments(t.aseg.withColumn("original", F.col("speaker")), 2).select("episode_id", "original", "seg_id")


@query("number_speakers", "F1", """SELECT episode_id, seg_id, coalesce('SPEAKER_'||lpad(p::VARCHAR,2,'0'),'SPEAKER_XX') AS label FROM (SELECT episode_id, seg_id, CASE WHEN seg_id%7<>6 THEN speaker END AS speaker FROM seg) s
  LEFT JOIN (SELECT episode_id, speaker, row_number() OVER (PARTITION BY episode_id ORDER BY min(seg_id))-1 AS p FROM seg WHERE seg_id%7<>6 GROUP BY episode_id, speaker) f USING (episode_id, speaker)""", "seg")
def number_speakers(t):
    some = t.seg.withColumn("speaker", F.when(F.col("seg_id") % 7 != 6, F.col("speaker")))
    return T.number_speakers(some).select("episode_id", "seg_id", "label")


@query("srt_index", "F4", """SELECT episode_id, seg_id, n AS srt_no FROM (SELECT episode_id, seg_id, row_number() OVER (PARTITION BY episode_id ORDER BY seg_id) AS n FROM seg) WHERE seg_id%5<>2""", "seg")
def srt_index(t):
    blank = t.seg.withColumn("text", F.when(F.col("seg_id") % 5 == 2, F.lit("  ")).otherwise(F.col("text")))
    return T.srt_index(blank, skip_blank=True).select("episode_id", "seg_id", "srt_no")


@query("reindex", "F12", """SELECT episode_id, turn_id, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, turn_id)-1 AS segment_id FROM turn_ovl""", "turn_ovl")
def reindex(t):
    return T.reindex(t.turn_ovl, ("start_ms", "turn_id")).select("episode_id", "turn_id", "segment_id")


@query("text_lines", "C8 B1", f"""SELECT episode_id, seg_id, '['||{ts('start_ms')}||'] '||speaker||': '||text||CASE WHEN start_ms%1000<>0 THEN ' ['||split_part({ts('start_ms')},'.',1)||']' ELSE '' END AS line FROM seg""", "seg")
def text_lines(t):
    return T.text_lines(t.seg)


_HEAD = """SELECT episode_id, 0 AS section, ord AS pos, 0 AS sub, 'Show Name: Test' AS line FROM (SELECT DISTINCT episode_id, 0 AS ord FROM seg)
  UNION ALL SELECT episode_id, 0, 1, 0, 'Segment Count: custom' FROM (SELECT DISTINCT episode_id FROM seg)
  UNION ALL SELECT episode_id, 0, 1000001, 0, 'Speaker Order: '||string_agg(speaker, ',' ORDER BY f) FROM (SELECT episode_id, speaker, min(seg_id) AS f FROM aseg GROUP BY ALL) GROUP BY 1
  UNION ALL SELECT episode_id, 0, 1000002, 0, 'Total Duration Seconds: '||{0} FROM (SELECT episode_id, sum(end_ms-start_ms)::BIGINT AS d FROM aseg GROUP BY 1)
  UNION ALL SELECT DISTINCT episode_id, 0, 1099511627776, 0, '' FROM seg""".replace("{0}", ms2("d"))


def _header(t):
    return t.seg.select("episode_id").distinct().select(
        "episode_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("ord"), F.lit("show_name").alias("key"), F.lit("Test").alias("value")),
            F.struct(F.lit(1).alias("ord"), F.lit("segment_count").alias("key"), F.lit("custom").alias("value")),
        )),
    )


@query("render_text", "B1", f"""SELECT episode_id, section, pos::BIGINT AS pos, sub, line FROM ({_HEAD} UNION ALL SELECT episode_id, 1, seg_id, 0, '['||{ts('start_ms')}||'] '||speaker||': '||text FROM aseg)""", "seg aseg")
def render_text(t):
    return T.render_text(t.aseg, T.summary_metadata(t.aseg), _header(t))


_MIX = "array_to_string(list_transform(mix, lambda m: m.speaker||':'||" + ms2("m.dur_ms") + "||'s'),', ')"
_CNT = "array_to_string(list_transform(mix, lambda m: m.speaker||':'||m.n_words),', ')"
_WORDS = (
    "array_to_string(list_transform(words[1:12], lambda w: w.word||'['||" + ts("w.start_ms") + "||'-'||" + ts("w.end_ms")
    + "||']'||CASE WHEN w.speaker<>'Unknown' THEN '@'||w.speaker ELSE '' END),', ')||CASE WHEN len(words)>12 THEN ', ...(+'||(len(words)-12)||' more)' ELSE '' END"
)


@query("render_text_details", "B2", f"""SELECT episode_id, 1 AS section, seg_id AS pos, sub, line FROM (
  SELECT episode_id, seg_id, 0 AS sub, '['||{ts('start_ms')}||'] '||speaker||': '||text AS line FROM aseg
  UNION ALL SELECT episode_id, seg_id, 1, '    '||concat_ws('; ', 'speaker_conf='||{fixed2('speaker_conf')}, 'asr_conf='||{fixed2('asr_conf')}, 'mix='||{_MIX}, 'speaker_counts='||{_CNT}, 'words='||len(words)) FROM aseg
  UNION ALL SELECT episode_id, seg_id, 2, '    Words: '||{_WORDS} FROM aseg)""", "aseg")
def render_text_details(t):
    return T.render_text(t.aseg, details=True)


@query("render_srt", "B3", rf"""SELECT episode_id, n AS srt_no, regexp_replace(n||chr(10)||{ts('start_ms', ',')}||' --> '||{ts('end_ms', ',')}||chr(10)||'['||speaker||'] '||text,'[ \t\n\r\f]+$','') AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_id) AS n FROM aseg)""", "aseg")
def render_srt(t):
    return T.render_srt(t.aseg)


@query("render_srt_details", "B3", f"""SELECT episode_id, n AS srt_no, n||chr(10)||{ts('start_ms', ',')}||' --> '||{ts('end_ms', ',')}||chr(10)||'['||speaker||'] '||text||chr(10)
  ||concat_ws(' | ','speaker_conf='||{fixed2('speaker_conf')}, 'asr_conf='||{fixed2('asr_conf')}, 'mix='||{_MIX}, 'words='||len(words))||chr(10)
  ||'word_window='||{ms2('words[-1].end_ms-words[1].start_ms')}||'s' AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_id) AS n FROM aseg)""", "aseg")
def render_srt_details(t):
    return T.render_srt(t.aseg, details=True)


@query("draft_srt", "F4 F1 B3", rf"""SELECT s.episode_id, n AS srt_no, regexp_replace(n||chr(10)||{ts('start_ms', ',')}||' --> '||{ts('end_ms', ',')}||chr(10)||'[SPEAKER_'||lpad(p::VARCHAR,2,'0')||'] '||text,'[ \t\n\r\f]+$','') AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_id) AS n FROM seg) s
  JOIN (SELECT episode_id, speaker, row_number() OVER (PARTITION BY episode_id ORDER BY min(seg_id))-1 AS p FROM seg GROUP BY episode_id, speaker) f USING (episode_id, speaker)""", "seg")
def draft_srt(t):
    """Numbered speakers instead of names, blank segments leaving holes in the numbering."""
    labelled = T.number_speakers(t.seg).withColumn("speaker", F.col("label"))
    return T.render_srt(labelled, skip_blank=True)


@query("to_document", "B4")
def to_document(t):
    """Nested JSON; no SQL check because JSON number and key spelling differ between engines."""
    extras = t.seg.select("episode_id").distinct().select("episode_id", F.lit(9).alias("ord"), F.lit("segment_count").alias("key"), F.lit("extra").alias("value"))
    return T.to_document(t.aseg, extras)


_ABOUT = """SELECT s.episode_id, s.n AS asr_segments, coalesce(t.n,0) AS turns, coalesce(w.n,0) AS words_aligned, coalesce(w.u,0) AS unaligned, coalesce(p.speakers,'') AS speakers
  FROM (SELECT episode_id, count(*) AS n FROM seg GROUP BY 1) s LEFT JOIN (SELECT episode_id, count(*) AS n FROM turn GROUP BY 1) t USING (episode_id)
  LEFT JOIN (SELECT episode_id, count(*) AS n, count(*) FILTER (speaker='Unknown') AS u FROM aligned GROUP BY 1) w USING (episode_id)
  LEFT JOIN (SELECT episode_id, string_agg(speaker, ',' ORDER BY f) AS speakers FROM (SELECT episode_id, speaker, min(seg_id*1000000+first_idx) AS f FROM mix GROUP BY ALL) GROUP BY 1) p USING (episode_id)"""


@query("document_content", "B4", f"""SELECT g.episode_id, g.seg_id, g.seg_id//2 AS part, g.speaker, g.text, g.start_ms, g.end_ms, CASE WHEN g.seg_id<2 THEN a.speakers END AS speakers,
  CASE WHEN g.seg_id<2 THEN a.words_aligned END AS words_aligned, CASE WHEN g.seg_id<2 THEN a.unaligned END AS unaligned, CASE WHEN g.seg_id<2 THEN 'extra' END AS segment_count,
  CASE WHEN g.seg_id<2 THEN c.fixes END AS fixes FROM seg g JOIN ({_ABOUT}) a USING (episode_id)
  JOIN (SELECT episode_id, string_agg(speaker||'>'||upper(speaker), ',' ORDER BY speaker) AS fixes FROM (SELECT DISTINCT episode_id, speaker FROM seg) GROUP BY 1) c USING (episode_id)""", "seg turn aligned mix")
def document_content(t):
    """Documents of two segments a part, parsed again: segments, and on the first part what is about the whole."""
    extras = t.seg.select("episode_id").distinct().select("episode_id", F.lit(9).alias("ord"), F.lit("segment_count").alias("key"), F.lit("extra").alias("value"))
    fixes = t.seg.select("episode_id", F.col("speaker").alias("original"), F.upper("speaker").alias("corrected"), F.upper("speaker").alias("canonical"),
                         F.lit("alias").alias("method"), F.lit(0.95).alias("confidence"))
    made = T.to_document(t.seg.drop("ws"), extras, 2, T.alignment_summary(t.seg, t.aligned, t.turn), fixes)
    kinds = """episode_id bigint, part bigint, metadata map<string, string>, segments array<struct<seg_id bigint, start_ms bigint, end_ms bigint, speaker string, text string>>,
      alignment struct<metadata struct<words_aligned bigint, unaligned bigint, speakers array<string>>>, name_corrections array<struct<original string, corrected string>>"""
    d = made.select(F.from_json("document", kinds).alias("d")).select("d.*").withColumn("s", F.explode("segments"))
    return d.select(
        "episode_id", "s.seg_id", "part", "s.speaker", "s.text", "s.start_ms", "s.end_ms", F.array_join("alignment.metadata.speakers", ",").alias("speakers"),
        "alignment.metadata.words_aligned", "alignment.metadata.unaligned", F.col("metadata")["segment_count"].alias("segment_count"),
        F.array_join(F.transform("name_corrections", lambda c: F.concat(c["original"], F.lit(">"), c["corrected"])), ",").alias("fixes"),
    )
