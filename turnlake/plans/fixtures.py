"""Transcript-shaped views over the driver tables, in Spark and (as CTEs) in SQL.

Every view covers its whole source table; the work of a query grows with the data.
Derived corruption (shortened turns, altered words) follows fixed arithmetic rules.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import wide
from ..functions.intervals import floor_div
from ..functions.ordered import prefix_scan
from ..functions.text import words_of
from ..operators.alignment import align_midpoint
from ..operators.transcript import aligned_segments
from ..session import settle

WORD_MS = 400
_STAGED: dict[tuple[str, str], DataFrame] = {}


class Tables:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def seg(self) -> DataFrame:
        """Timed segments, staged once per application as the table the operators expect.

        Real inputs are such tables already; only these test data must be derived.
        """
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _STAGED:
            _STAGED[key] = settle(wide(self._derive_seg(), "episode_id", "seg_id"), "segments")
        return _STAGED[key]

    def _derive_seg(self) -> DataFrame:
        base = self.raw("conversations").select(
            F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_id"), F.col("role").alias("speaker"),
            "text", words_of(F.col("text")).alias("ws"),
        ).withColumn("nw", F.size("ws"))
        timed = prefix_scan(
            base, ["episode_id"], ["seg_id"], floor_div(F.col("seg_id"), 1024), sums={"__w": F.col("nw")}
        )
        return timed.withColumn("start_ms", (F.col("__w") * WORD_MS).cast("bigint")).withColumn(
            "end_ms", F.col("start_ms") + F.col("nw") * WORD_MS
        ).drop("__w")

    @cached_property
    def word(self) -> DataFrame:
        w = self.seg.select(
            "episode_id", "seg_id", F.col("speaker").alias("said_by"), F.col("start_ms").alias("s"),
            F.posexplode("ws").alias("i", "word"),
        )
        idx = F.col("i") + 1
        return w.select(
            "episode_id", "seg_id", idx.alias("word_idx"), "word",
            (F.col("s") + F.col("i") * WORD_MS).alias("start_ms"), (F.col("s") + idx * WORD_MS).alias("end_ms"),
            (((idx * 37 + F.col("seg_id") * 11 + F.col("episode_id") * 7) % 100) / 100).alias("prob"), "said_by",
        )

    @cached_property
    def plain_word(self) -> DataFrame:
        return self.word.drop("said_by")

    @cached_property
    def turn(self) -> DataFrame:
        start = F.col("start_ms") + 300
        short = (F.col("episode_id") + F.col("seg_id")) % 9 == 4
        return self.seg.select(
            "episode_id", F.col("seg_id").alias("turn_id"), "speaker", start.alias("start_ms"),
            F.when(short, start + F.col("nw") * 100).otherwise(F.col("end_ms") + 300).alias("end_ms"),
            (((F.col("seg_id") * 17 + F.col("episode_id") * 5) % 100) / 100).alias("conf"),
        )

    @cached_property
    def turn_ovl(self) -> DataFrame:
        guest = self.seg.filter("seg_id >= 1").select(
            "episode_id", (F.col("seg_id") * 2 + 1).alias("turn_id"), F.lit("guest").alias("speaker"),
            F.greatest(F.col("start_ms") - 500, F.lit(0)).alias("start_ms"),
            (F.greatest(F.col("start_ms") - 500, F.lit(0)) + 600).alias("end_ms"), F.lit(0.5).alias("conf"),
        )
        return self.turn.withColumn("turn_id", F.col("turn_id") * 2).unionByName(guest)

    @cached_property
    def ref_turn(self) -> DataFrame:
        return self.seg.select("episode_id", F.col("seg_id").alias("turn_id"), "speaker", "start_ms", "end_ms")

    @cached_property
    def duration(self) -> DataFrame:
        return self.seg.groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms"))

    @cached_property
    def aligned(self) -> DataFrame:
        return align_midpoint(self.plain_word, self.turn)

    @cached_property
    def aseg(self) -> DataFrame:
        """Aligned segments with their words as an array (words of one segment row)."""
        words = self.aligned.groupBy("episode_id", "seg_id").agg(
            F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms", "prob", "speaker"))).alias("words")
        )
        return aligned_segments(self.seg.drop("ws"), self.aligned).drop("n_words").join(words, ["episode_id", "seg_id"])

    @cached_property
    def spoken(self) -> DataFrame:
        """Segments with the speaker of alignment and their word count."""
        return aligned_segments(self.seg.drop("ws", "text"), self.aligned, with_mix=False).select(
            "episode_id", "seg_id", "speaker", "start_ms", "end_ms", "n_words"
        )

    def _heard_text(self, tool: str) -> DataFrame:
        if tool == "asr_a":
            ws = F.filter(
                F.transform(
                    "ws",
                    lambda x, i: F.when((i + 1) % 7 == 0, F.lit("")).when((i + 1) % 11 == 0, F.lit("zz")).otherwise(x),
                ),
                lambda x: x != "",
            )
            text = F.concat(F.array_join(ws, " "), F.when(F.col("seg_id") % 3 == 0, F.lit(" uh")).otherwise(""))
        else:
            text = F.array_join(
                F.transform("ws", lambda x, i: F.when((i + 1) % 5 == 0, F.lit("qq")).otherwise(x)), " "
            )
        return self.seg.select(
            "episode_id", "seg_id", F.lit(tool).alias("tool"), F.col("text").alias("ref_text"), text.alias("hyp_text")
        )

    @cached_property
    def hyp(self) -> DataFrame:
        return self._heard_text("asr_a")

    @cached_property
    def hyp_tools(self) -> DataFrame:
        return self.hyp.unionByName(self._heard_text("asr_b"))

    # --- vectors ---------------------------------------------------------------

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("label").cast("bigint").alias("label"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    @cached_property
    def bank(self) -> DataFrame:
        return self.vectors.filter("vec_id % 5 <> 0").select(
            F.col("vec_id").alias("emb_id"), F.col("label").alias("speaker_id"),
            F.concat(F.lit("Speaker "), F.col("label").cast("string")).alias("display_name"), "vec",
            ((F.col("vec_id") * 13 % 100) / 100).alias("quality"), F.col("vec_id").alias("created"),
        )

    @cached_property
    def query(self) -> DataFrame:
        """The other role of the same table: clusters heard in three episodes."""
        return self.vectors.filter("vec_id % 5 = 0").select(
            F.col("vec_id").cast("string").alias("qid"), (F.col("vec_id") % 3).alias("episode_id"),
            F.concat(F.lit("SPEAKER_"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("cluster_id"), "vec",
            "vec_id",
        )

    @cached_property
    def cluster_turn(self) -> DataFrame:
        start = F.col("vec_id") * 1000
        return self.query.select(
            "episode_id", F.col("vec_id").alias("turn_id"), F.col("cluster_id").alias("speaker"),
            start.alias("start_ms"), (start + 200 + F.col("vec_id") * 13 % 900).alias("end_ms"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        return self.bank.groupBy("speaker_id", "display_name").agg(
            F.count(F.lit(1)).alias("total_segments"), F.min("created").alias("first_episode")
        ).select(
            F.concat(F.lit("speaker"), F.col("speaker_id").cast("string")).alias("key"), "display_name",
            "total_segments", "first_episode",
        )

    @cached_property
    def clip(self) -> DataFrame:
        """Clips of 64 samples at 64 Hz; scaled, muted and clipped by rule to reach every outcome."""
        gain = F.when(F.col("vec_id") % 7 == 3, 0.0).when(F.col("vec_id") % 7 == 5, 0.02).when(
            F.col("vec_id") % 7 == 6, 4.0).otherwise(1.0)
        n = F.when(F.col("vec_id") % 11 == 4, 40).otherwise(64)
        return self.vectors.select(
            F.col("vec_id").alias("clip_id"), F.col("label").alias("speaker_id"),
            F.transform(F.slice("vec", F.lit(1), n), lambda x: x * gain).alias("samples"),
        )

    # --- events ----------------------------------------------------------------

    @cached_property
    def mask(self) -> DataFrame:
        start = F.col("event_id") * 997 % 400000
        return self.raw("events").select(
            F.col("event_id").alias("mask_id"), F.col("user_id").alias("episode_id"), start.alias("start_ms"),
            (start + F.floor("value")).cast("bigint").alias("end_ms"),
            F.when(F.col("event_type") == "click", "tone").when(F.col("event_type") == "view", "mute")
            .otherwise("noise").alias("type"),
            (F.col("user_id") % 7).alias("person_id"), ((F.col("event_id") * 13 % 100) / 100).alias("conf"),
            (800 + F.col("event_id") * 37 % 1700).alias("freq_hz"),
        )

    @cached_property
    def cost(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("event_type").alias("provider"),
            F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"),
            (F.col("value") / 1000).alias("cost_usd"), F.col("value").alias("duration_s"),
            F.concat(F.lit("media/"), F.col("user_id").cast("string"), F.lit(".wav")).alias("media_path"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def runtime(self) -> DataFrame:
        audio = 60 + F.col("event_id") % 100
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("clip"), F.col("event_type").alias("tool"),
            F.when(F.col("event_id") % 2 == 0, "asr").otherwise("diarization").alias("stage"),
            F.col("value").alias("duration_s"), audio.cast("double").alias("audio_s"),
            F.when(F.col("event_id") % 10 != 0, F.col("value") / audio).alias("rtf"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def run(self) -> DataFrame:
        return self.raw("events").groupBy(F.col("user_id").alias("episode_id")).agg(
            F.min(F.col("ts").cast("timestamp")).alias("started"), F.max(F.col("ts").cast("timestamp")).alias("ended")
        ).withColumn("status", F.when(F.col("episode_id") % 7 == 0, "failed").otherwise("completed"))

    # --- names -----------------------------------------------------------------

    @cached_property
    def cast(self) -> DataFrame:
        empty = F.array().cast("array<string>")
        return self.raw("part").groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("ord")).select(
            "ord", "canonical", F.when(F.col("ord") % 2 == 0, "main").otherwise("guest").alias("role"),
            F.when(F.col("ord") % 3 == 0, F.array(F.upper(F.substring_index("canonical", " ", 1)))).otherwise(empty).alias("aliases"),
            F.when(F.col("ord") % 2 == 0, F.array(F.reverse("canonical"))).otherwise(empty).alias("misspellings"),
        )

    @cached_property
    def bank_names(self) -> DataFrame:
        """Profiles as a second source of names: the brands."""
        empty = F.array().cast("array<string>")
        return self.raw("part").groupBy(F.col("p_brand").alias("canonical")).agg(F.min("p_partkey").alias("ord")).select(
            "ord", "canonical", F.regexp_replace(F.lower("canonical"), "[^a-z0-9]", "").alias("speaker_key"),
            F.array(F.replace("canonical", F.lit("Brand#"), F.lit("B"))).alias("aliases"), empty.alias("misspellings"),
        )

    @cached_property
    def heard(self) -> DataFrame:
        """Every part with a name as heard: exact, alias, misspelt, or with one letter lost."""
        at = F.col("p_partkey") % 3 + 2
        lost = F.concat(
            F.substring("p_name", F.lit(1), (at - 1).cast("int")),
            F.substring(F.col("p_name"), (at + 1).cast("int"), F.length("p_name")),
        )
        pick = F.col("p_partkey") % 5
        return self.raw("part").select(
            F.col("p_partkey").alias("nid"),
            F.when(pick == 0, F.upper("p_name")).when(pick == 1, F.substring_index("p_name", " ", 1))
            .when(pick == 2, F.reverse("p_name")).when(pick == 3, F.col("p_brand")).otherwise(lost).alias("heard"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """A labelled transcript line per part."""
        return self.heard.select(
            (F.col("nid") % 50).alias("doc_id"), F.col("nid").alias("line_no"),
            F.concat(F.lit("[00:00:15] "), F.initcap("heard"), F.lit(": said number "), F.col("nid").cast("string")).alias("line"),
        )

    @cached_property
    def assign(self) -> DataFrame:
        """Reviewer spans: every turn, 100 ms in from both sides."""
        return self.turn.select(
            "episode_id", F.col("turn_id").alias("ord"), (F.col("start_ms") + 100).alias("start_ms"),
            (F.col("end_ms") - 100).alias("end_ms"),
            F.concat(F.lit("Reviewer"), (F.col("turn_id") % 3).cast("string")).alias("speaker"),
        )

    @cached_property
    def frame(self) -> DataFrame:
        i = F.col("word_idx")
        return self.word.select(
            "episode_id", (F.col("start_ms") + 200).alias("t_ms"), F.col("said_by").alias("label"),
            (-20.0 - i * 7 % 40).alias("rms_db"), (i * 3 % 100 / 100).alias("flatness"),
            (500 + i * 17 % 2500).cast("double").alias("centroid_hz"),
        )

    @cached_property
    def artifact(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("episode_id"), F.col("event_type").alias("key"), "event_id", "value"
        )


SPACE_RX = r"[ \t\n\r\f]+"

# SQL twins: name -> (needed views, body).
VIEWS: dict[str, tuple[list[str], str]] = {
    "seg0": ([], rf"""SELECT conv_id AS episode_id, turn AS seg_id, role AS speaker, text,
        list_filter(regexp_split_to_array(text, '{SPACE_RX}'), lambda x: x <> '') AS ws FROM conversations"""),
    "seg": (["seg0"], """SELECT *, len(ws) AS nw,
        (400*coalesce(sum(len(ws)) OVER w,0))::BIGINT AS start_ms,
        (400*coalesce(sum(len(ws)) OVER w,0) + 400*len(ws))::BIGINT AS end_ms FROM seg0
        WINDOW w AS (PARTITION BY episode_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "word": (["seg"], """SELECT episode_id, seg_id, i AS word_idx, word, start_ms + (i-1)*400 AS start_ms,
        start_ms + i*400 AS end_ms, ((i*37 + seg_id*11 + episode_id*7) % 100)/100.0 AS prob, speaker AS said_by
        FROM (SELECT episode_id, seg_id, start_ms, speaker, unnest(ws) AS word, unnest(range(1, len(ws)+1))::INT AS i FROM seg)"""),
    "turn": (["seg"], """SELECT episode_id, seg_id AS turn_id, speaker, start_ms+300 AS start_ms,
        CASE WHEN (episode_id+seg_id)%9=4 THEN start_ms+300+nw*100 ELSE end_ms+300 END AS end_ms,
        ((seg_id*17+episode_id*5)%100)/100.0 AS conf FROM seg"""),
    "turn_ovl": (["turn", "seg"], """SELECT episode_id, turn_id*2 AS turn_id, speaker, start_ms, end_ms, conf FROM turn
        UNION ALL SELECT episode_id, seg_id*2+1, 'guest', greatest(start_ms-500,0), greatest(start_ms-500,0)+600, 0.5
        FROM seg WHERE seg_id>=1"""),
    "ref_turn": (["seg"], "SELECT episode_id, seg_id AS turn_id, speaker, start_ms, end_ms FROM seg"),
    "duration": (["seg"], "SELECT episode_id, max(end_ms) AS duration_ms FROM seg GROUP BY 1"),
    "aligned": (["word", "turn"], """SELECT w.episode_id, w.seg_id, w.word_idx, w.word, w.start_ms, w.end_ms, w.prob,
        coalesce(t.speaker,'Unknown') AS speaker FROM word w LEFT JOIN turn t ON w.episode_id=t.episode_id
        AND 2*t.start_ms <= w.start_ms+w.end_ms AND w.start_ms+w.end_ms < 2*t.end_ms"""),
    "mix": (["aligned"], """SELECT episode_id, seg_id, speaker, sum(end_ms-start_ms)::BIGINT AS dur_ms, count(*) AS n_words,
        min(word_idx) AS first_idx FROM aligned WHERE speaker<>'Unknown' GROUP BY ALL"""),
    "dom": (["mix", "aligned"], """SELECT a.episode_id, a.seg_id, coalesce(m.speaker,'Unknown') AS speaker,
        CASE WHEN m.speaker IS NULL THEN a.asr_conf ELSE m.dur_ms/m.total END AS speaker_conf, a.asr_conf, a.n_words
        FROM (SELECT episode_id, seg_id, sum(round(prob*1e9)::BIGINT)::BIGINT/1e9/count(*) AS asr_conf, count(*) AS n_words FROM aligned GROUP BY ALL) a
        LEFT JOIN (SELECT *, sum(dur_ms) OVER (PARTITION BY episode_id, seg_id) AS total FROM mix
          QUALIFY row_number() OVER (PARTITION BY episode_id, seg_id ORDER BY dur_ms DESC, first_idx)=1) m
        USING (episode_id, seg_id)"""),
    "mixlist": (["mix"], """SELECT episode_id, seg_id,
        list({'speaker': speaker, 'dur_ms': dur_ms, 'n_words': n_words} ORDER BY speaker) AS mix FROM mix GROUP BY ALL"""),
    "aseg": (["seg", "dom", "mixlist", "aligned"], """SELECT s.episode_id, s.seg_id, s.text, s.start_ms, s.end_ms, s.nw, d.speaker,
        d.speaker_conf, d.asr_conf, m.mix, w.words FROM seg s JOIN dom d USING (episode_id, seg_id)
        LEFT JOIN mixlist m USING (episode_id, seg_id)
        JOIN (SELECT episode_id, seg_id, list({'word': word, 'start_ms': start_ms, 'end_ms': end_ms, 'speaker': speaker}
          ORDER BY word_idx) AS words FROM aligned GROUP BY ALL) w USING (episode_id, seg_id)"""),
    "spoken": (["seg", "dom"], """SELECT episode_id, seg_id, d.speaker, start_ms, end_ms, n_words FROM seg s
        JOIN dom d USING (episode_id, seg_id)"""),
    "speaking": (["spoken"], """SELECT *, round(dur_ms*100/sum(dur_ms) OVER (PARTITION BY episode_id),6) AS pct FROM (
        SELECT episode_id, speaker, sum(end_ms-start_ms)::BIGINT AS dur_ms, sum(n_words)::BIGINT AS word_count,
        count(*) AS segment_count FROM spoken GROUP BY ALL)"""),
    "hyp": (["seg"], """SELECT episode_id, seg_id, 'asr_a' AS tool, text AS ref_text,
        array_to_string(list_filter(list_transform(ws, lambda x, i: CASE WHEN i%7=0 THEN '' WHEN i%11=0 THEN 'zz' ELSE x END),
        lambda x: x<>''),' ') || CASE WHEN seg_id%3=0 THEN ' uh' ELSE '' END AS hyp_text FROM seg"""),
    "hyp_tools": (["hyp", "seg"], """SELECT * FROM hyp UNION ALL SELECT episode_id, seg_id, 'asr_b', text,
        array_to_string(list_transform(ws, lambda x, i: CASE WHEN i%5=0 THEN 'qq' ELSE x END),' ') FROM seg"""),
    "vectors": ([], "SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS vec FROM embeddings"),
    "bank": (["vectors"], """SELECT vec_id AS emb_id, label AS speaker_id, 'Speaker '||label AS display_name, vec,
        (vec_id*13%100)/100.0 AS quality, vec_id AS created FROM vectors WHERE vec_id%5<>0"""),
    "query": (["vectors"], """SELECT vec_id::VARCHAR AS qid, vec_id%3 AS episode_id,
        'SPEAKER_'||lpad(label::VARCHAR,2,'0') AS cluster_id, vec, vec_id FROM vectors WHERE vec_id%5=0"""),
    "cluster_turn": (["query"], """SELECT episode_id, vec_id AS turn_id, cluster_id AS speaker, vec_id*1000 AS start_ms,
        vec_id*1000+200+vec_id*13%900 AS end_ms FROM query"""),
    "profile": (["bank"], """SELECT 'speaker'||speaker_id AS key, display_name, count(*) AS total_segments,
        min(created) AS first_episode FROM bank GROUP BY speaker_id, display_name"""),
    "clip": (["vectors"], """SELECT vec_id AS clip_id, label AS speaker_id, list_transform(
        vec[1:(CASE WHEN vec_id%11=4 THEN 40 ELSE 64 END)], lambda x: x*(CASE vec_id%7 WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN 0.02::DOUBLE
        WHEN 6 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END)) AS samples FROM vectors"""),
    "mask": ([], """SELECT event_id AS mask_id, user_id AS episode_id, event_id*997%400000 AS start_ms,
        (event_id*997%400000 + floor(value))::BIGINT AS end_ms,
        CASE event_type WHEN 'click' THEN 'tone' WHEN 'view' THEN 'mute' ELSE 'noise' END AS type,
        user_id%7 AS person_id, (event_id*13%100)/100.0 AS conf, 800+event_id*37%1700 AS freq_hz FROM events"""),
    "cost": ([], """SELECT event_id, event_type AS provider, 'm'||(user_id%5) AS model, value/1000 AS cost_usd,
        value AS duration_s, 'media/'||user_id||'.wav' AS media_path, ts FROM events"""),
    "runtime": ([], """SELECT event_id, user_id AS clip, event_type AS tool,
        CASE WHEN event_id%2=0 THEN 'asr' ELSE 'diarization' END AS stage, value AS duration_s,
        (60+event_id%100)::DOUBLE AS audio_s, CASE WHEN event_id%10<>0 THEN value/(60+event_id%100) END AS rtf, ts FROM events"""),
    "run": ([], """SELECT user_id AS episode_id, min(ts) AS started, max(ts) AS ended,
        CASE WHEN user_id%7=0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id"""),
    "castv": ([], """SELECT min(p_partkey) AS ord, p_name AS canonical,
        CASE WHEN min(p_partkey)%2=0 THEN 'main' ELSE 'guest' END AS role,
        CASE WHEN min(p_partkey)%3=0 THEN [upper(split_part(p_name,' ',1))] ELSE []::VARCHAR[] END AS aliases,
        CASE WHEN min(p_partkey)%2=0 THEN [reverse(p_name)] ELSE []::VARCHAR[] END AS misspellings FROM part GROUP BY p_name"""),
    "bank_names": ([], """SELECT min(p_partkey) AS ord, p_brand AS canonical, regexp_replace(lower(p_brand),'[^a-z0-9]','','g') AS speaker_key,
        [replace(p_brand,'Brand#','B')] AS aliases, []::VARCHAR[] AS misspellings FROM part GROUP BY p_brand"""),
    "heard": ([], """SELECT p_partkey AS nid, CASE p_partkey%5 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name,' ',1)
        WHEN 2 THEN reverse(p_name) WHEN 3 THEN p_brand
        ELSE substr(p_name,1,(p_partkey%3+1)::INT)||substr(p_name,(p_partkey%3+3)::INT) END AS heard FROM part"""),
    "names_all": (["castv", "bank_names"], """SELECT 0 AS src, ord, canonical, 'canonical' AS kind, 0 AS pos, canonical AS name FROM castv
        UNION ALL SELECT 0, ord, canonical, 'alias', 0, unnest(aliases) FROM castv
        UNION ALL SELECT 0, ord, canonical, 'misspelling', 0, unnest(misspellings) FROM castv
        UNION ALL SELECT 1, ord, canonical, 'canonical', 0, canonical FROM bank_names
        UNION ALL SELECT 1, ord, canonical, 'alias', 0, unnest(aliases) FROM bank_names"""),
    "lookup": (["names_all"], r"""SELECT kind, regexp_replace(lower(strip_accents(name)),'[^\p{L}\p{N}]','','g') AS norm, canonical,
        CASE kind WHEN 'canonical' THEN 1.0::DOUBLE WHEN 'alias' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS conf FROM names_all
        QUALIFY row_number() OVER (PARTITION BY kind, regexp_replace(lower(strip_accents(name)),'[^\p{L}\p{N}]','','g')
        ORDER BY src, ord, pos)=1"""),
    "cands": (["castv", "bank_names"], r"""SELECT regexp_replace(lower(canonical),'[^\p{L}\p{N}]','','g') AS norm, canonical, src, ord FROM (
        SELECT canonical, 0 AS src, ord FROM castv UNION ALL SELECT canonical, 1, ord FROM bank_names)"""),
    "resolved": (["heard", "lookup", "cands"], r"""SELECT n.norm, coalesce(x.canonical, CASE WHEN f.score>=0.8 THEN f.canonical END) AS canonical,
        coalesce(x.kind, CASE WHEN f.score>=0.8 THEN 'fuzzy' ELSE 'no_match' END) AS method, coalesce(x.conf, f.score) AS conf
        FROM (SELECT DISTINCT regexp_replace(lower(heard),'[^\p{L}\p{N}]','','g') AS norm FROM heard) n
        LEFT JOIN (SELECT * FROM lookup QUALIFY row_number() OVER (PARTITION BY norm ORDER BY
          CASE kind WHEN 'canonical' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END)=1) x ON n.norm=x.norm
        LEFT JOIN LATERAL (SELECT 1-levenshtein(n.norm,c.norm)::DOUBLE/greatest(length(n.norm),length(c.norm)) AS score, c.canonical
          FROM cands c ORDER BY score DESC, src, ord LIMIT 1) f ON true"""),
    "lines": (["heard"], """SELECT nid%50 AS doc_id, nid AS line_no, '[00:00:15] ' ||
        array_to_string(list_transform(string_split(lower(heard),' '), lambda w: upper(w[1:1])||w[2:]),' ') ||
        ': said number '||nid AS line FROM heard"""),
    "assign": (["turn"], """SELECT episode_id, turn_id AS ord, start_ms+100 AS start_ms, end_ms-100 AS end_ms,
        'Reviewer'||(turn_id%3) AS speaker FROM turn"""),
    "frame": (["word"], """SELECT episode_id, start_ms+200 AS t_ms, said_by AS label, (-20.0 - word_idx*7%40)::DOUBLE AS rms_db,
        (word_idx*3%100)/100.0 AS flatness, (500+word_idx*17%2500)::DOUBLE AS centroid_hz FROM word"""),
    "artifact": ([], "SELECT user_id AS episode_id, event_type AS key, event_id, value FROM events"),
}


def with_views(body: str, needs: list[str], extra: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    if body.startswith("WITH "):
        head = ",\n" + body[len("WITH "):]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + head
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
