"""Vectors, pages, archives, mixing, packing and the pipeline against brute force or exact round trips."""

import gzip
import html as markup
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnlake.llm import html, lines, minhash, mixing, packing, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- vectors -----------------------------------------------------------------------------------------------

def brute_vectors(rows, threshold=0.98):
    def sound(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = defaultdict(set)
    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if p == q and sound(x, p) and sound(y, q) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[a][0], len(links[a]), min(ids, default=None)))
    return sorted(out, key=str)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(25):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 7)):
            noise = rng.standard_normal(64) * rng.choice([0, 0.05, 0.12, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in (base + noise) * rng.choice([1, 3])], int(group % 3)))
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, rows[0][1], None), (503, [float("nan")] * 64, 1), (504, [None] * 64, 1),
             (505, [], 1), (506, rows[0][1][:32], 0), (507, [float("inf")] + [1.0] * 63, 1), (None, rows[0][1], 0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, _ = vectors.near_vectors(df)
    got = got.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
    assert vectors.near_vectors(df.limit(0))[0].count() == 0


def test_list_decoding_finds_the_largest_products():
    rng = np.random.default_rng(0)
    unit = rng.standard_normal((5, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = vectors.list_decode(unit, 8)
    turn, code, _, ranges = vectors._code(16)
    total = np.zeros((5, 1))
    for r, words in zip(ranges, code):
        total = (total[:, :, None] + ((unit @ turn)[:, r] @ words.T)[:, None, :]).reshape(5, -1)
    for k in range(5):
        assert set(got[k]) == set(np.argsort(-total[k])[:8])


# --- pages -------------------------------------------------------------------------------------------------

def test_pages_give_their_article(table):
    for r in table("pages").limit(60).collect():
        inside = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]).replace("<br>", " ")
        blocks = (re.sub(r"[\x20\x09-\x0d]+", " ", markup.unescape(b)).strip(" ") for b in re.split(r"</?(?:h1|p)>", inside))
        assert html.main_lines(r.html) == [b for b in blocks if b]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain words", ["plain words"]), ("<p>a &lt;b&gt;\n c<p>d<br>e", ["a <b> c", "d e"]),
    ("<body><header><h1>Site</h1></header><main><h1>T</h1><p>One long text of many words.</p><form>f</form></main><footer>x</footer>",
     ["T", "One long text of many words."]),
    ("<article><p>Main text that is long enough.</p><div class='comments'><p>me too</p></div><aside>s</aside></article>", ["Main text that is long enough."]),
    ("<div id=cookie-banner>We use cookies</div><div class=body><p>Body text here, long and plain.</p><script>if (a<b) x('</p>')</script></div>",
     ["Body text here, long and plain."]),
    ("<article><p>unclosed <i>tags <p>go on</article></b></b>", ["unclosed tags", "go on"]),
])
def test_page_cases(page, want):
    assert html.main_lines(page) == want


LONG, SHORT = "A sentence of the text that goes on for quite a while, as prose does. " * 3, "Few words here."
LINKS = "<div><ul>" + "".join(f"<li><a href='/{k}'>Go {k}</a></li>" for k in range(8)) + "</ul></div>"


@pytest.mark.parametrize("page, want", [
    (f"<body>{LINKS}<section><p>{LONG}<p>{LONG}<p>{LONG}</section><section><p>{LONG}</section>", [LONG] * 4),
    (f"<section><p>{LONG}</section>{LINKS}<section>{f'<p>{SHORT}</p>' * 40}</section>", [LONG] + [SHORT] * 40),
    (f"<section><p>{LONG}<p>{LONG}</section><section><ul>{f'<li>{SHORT}' * 9}</ul></section>", [LONG] * 2 + [SHORT] * 9),
    (f"{LINKS}<article><p>{LONG}<p>{LONG}</article>{LINKS}<article><h2>Two</h2><p>{LONG}</article>", [LONG, LONG, "Two", LONG]),
    (f"<article><p>{LONG}<p>{LONG}</article><article>{LINKS}</article>{LINKS}<div><h2>More</h2><div><p>{LONG}</div></div>", [LONG, LONG, "More", LONG]),
    (f"<div><p>{LONG}<table><tr><td>a<td>1<tr><td>b<td>2</table></div>{LINKS}", [LONG, "a", "1", "b", "2"]),
    (f"<table><tr><td>{LINKS}<td><p>{LONG}<p>{LONG}</table>", [LONG, LONG]),
])
def test_all_content_regions_stay(page, want):
    assert html.main_lines(page) == [w.strip() for w in want]


@pytest.mark.parametrize("page", [
    "<article class='post category-social tag-related'>{}</article>", "<div class='ad-free-content'>{}</div>", "<article id=share-price-crash>{}</article>",
    "<div class='has-sidebar'><article>{}</article><div class=sidebar><p>Other texts you may like, so they say, all of them long.</div></div>",
    "<div id='page-with-banner'>{}</div>", "<form action=/><article>{}</article><input></form>",
    "<div class='has-sidebar'><article>{}</article><ol class=comment-list><article class=comment-body><p>I too think that this is so, and more.</article></ol></div>",
    "<article class=post>{}</article><div id=comments>" + f"<p>{LONG}" * 9 + "</div>",
    "<article><header>{}</header></article><form><p>Your name and mail, please, and some words to us.</form>",
])
@pytest.mark.parametrize("around", ["{}", f"<body>{LINKS}{{}}{LINKS}", f"<nav><p>{LONG}</nav>{{}}<div class='cookie-banner'><p>{SHORT}</div>"])
def test_names_do_not_lose_articles(page, around):
    text = f"<h1>Title of it</h1><p>{LONG}<p>{SHORT}<p>{LONG}"
    assert html.main_lines(around.format(page.format(text))) == ["Title of it", LONG.strip(), SHORT, LONG.strip()]


def test_blocks_of_spaces_and_long_pages(spark):
    assert html.main_lines(f"<article><p>&nbsp;<p>{LONG}<p>&nbsp;&#8195;</article>") == [LONG.strip()]
    page = "<article>" + f"<p>{LONG}" * 8000 + "</article>" + "<div class=ad>" * 3000
    assert len(html.main_lines(page)) == 8000


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "extra"), (None, None, "<p>x " * 30000, "e"), (1, "u", "<p>x", "e")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), len(r.text)) for r in html.extract(df).collect())
    assert got == [("1", 0), ("1", 1), ("None", 30000 + 29999 * 2)]
    assert html.extract(df.limit(0)).count() == 0


# --- archives ----------------------------------------------------------------------------------------------

def record(name, body):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_reader_salvages_plain_archives():
    whole = [record(k, b"body %d WARC/1.1\r\n\r\n\r\n" % k * 5) for k in range(4)]
    bad = whole[1].replace(b"Content-Length: ", b"Content-Length: 9")
    got = list(warc.parse(whole[0] + b"junk" + bad + whole[2] + whole[3][:-9]))
    assert [h["warc-record-id"] for kind, _, h, _ in got if kind == "record"] == ["<urn:page:0>", "<urn:page:2>"]
    gaps = [(at, int(h["bytes"])) for kind, at, h, _ in got if kind == "gap"]
    assert gaps == [(len(whole[0]), 4 + len(bad)), (len(whole[0]) + 4 + len(bad) + len(whole[2]), len(whole[3]) - 9)]


def test_reader_salvages_members():
    members = [gzip.compress(record(k, b"text %d " % k * 50)) for k in range(4)]
    broken = members[1][:20] + b"\0\0\0\0" + members[1][24:]
    got = list(warc.parse(members[0] + broken + members[2] + b"tail" + members[3]))
    assert [h["warc-record-id"] for kind, _, h, _ in got if kind == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert sum(int(h["bytes"]) for kind, _, h, _ in got if kind == "gap") == len(broken) + 4


def salvaged(data):
    got = list(warc.parse(data))
    return [h["warc-record-id"][-2] for kind, _, h, _ in got if kind == "record"], [(at, int(h["bytes"])) for kind, at, h, _ in got if kind == "gap"]


@pytest.mark.parametrize("byte", [0, 1, 2, 12])
def test_reader_salvages_behind_a_damaged_first_member(byte):
    members = [gzip.compress(record(k, b"text %d " % k * 50)) for k in range(3)]
    first = members[0][:byte] + b"\xff" + members[0][byte + 1 :]
    assert salvaged(first + members[1] + members[2]) == (["1", "2"], [(0, len(first))])


def test_reader_salvages_both_formats_in_one_file():
    plain = [record(k, b"text %d " % k * 50) for k in range(6)]
    broken = gzip.compress(plain[0])[:-4]
    bad = b"WARC/1.0" + plain[3][8:-3]
    data = broken + plain[1] + gzip.compress(plain[2]) + bad + gzip.compress(plain[4]) + plain[5]
    at = len(broken + plain[1] + gzip.compress(plain[2]))
    assert salvaged(data) == (["1", "2", "4", "5"], [(0, len(broken)), (at, len(bad))])
    # A whole member that holds no record, here in a damaged record's payload, does not divide the gap.
    bad = record(0, b"x" * 9 + gzip.compress(b"no record"))[:-2]
    assert salvaged(bad + plain[1]) == (["1"], [(0, len(bad))])


def test_archive_round_trip(spark):
    long = "<p>é " * 60
    rows = [(1, "u", long), (2, "u\r\nx: y", long), (3, None, "WARC/1.1\r\n\r\n"), (4, "v", "WARC/1.1\r\n\r\n"), (5, "v", None), (None, "w", long),
            (1, "u", long), (7, "z", "\r\n\r\n" + "y" * 200_000 + "\r\n\r\nWARC/1.1\r\n"), (8, "z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = warc.round_trip(df)
    assert out.where("kind = 'gap'").count() == 0
    got = warc.resolve(out).collect()
    payloads = {None if r.record_id == "null" else int(r.record_id): bytes(r.payload).decode() for r in got}
    assert payloads == {i: h or "" for i, _, h in rows}
    kinds = Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    n = len(long.encode())
    assert kinds == Counter([("1", "response", None, n), ("1", "response", None, n), ("2", "revisit", "1", n), ("null", "revisit", "1", n),
                             ("3", "response", None, 12), ("4", "response", None, 12), ("5", "response", None, 0), ("8", "response", None, 0),
                             ("7", "response", None, 200_018)])
    empty = warc.plan_records(df.limit(0))
    assert empty.count() == 0


# --- mixing ------------------------------------------------------------------------------------------------

def test_targets_fill_by_weight(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 300)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    total, cap = 1.5 * 1810, {"a": 2000, "b": 20, "c": 1000, None: 600}
    weight, want = {"a": 3, "b": 1, "c": 2, None: 3}, {}
    open_ = set(cap)
    while True:
        rest, w = total - sum(want.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w >= cap[s]}
        if not over:
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    want |= {s: rest * weight[s] / w for s in open_}
    assert got == pytest.approx(want)


def test_mix_hits_targets_and_repeats(documents):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(int(rng.lognormvariate(4, 1)))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    rows += [(700, None, "a"), (701, "", "d"), (None, "x y z", "c"), rows[0], rows[0]]
    docs = documents(rows).withColumn("copies", F.lit(9))
    taken = mixing.sample(docs).collect()
    assert len(taken) == len(rows) and all(0 <= r.copies <= 2 for r in taken)
    words, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in taken:
        words[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s in words:
        assert abs(words[s] - target[s]) <= max(2, 0.02 * target[s])
    again = mixing.sample(docs.repartition(3)).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.copies) for r in rs)
    assert pick(again) == pick(taken)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(str(r.doc_id) for r in mixed.collect()) == Counter(str(r.doc_id) for r in taken for _ in range(r.copies))
    assert mixing.sample(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0


# --- packing -----------------------------------------------------------------------------------------------

def check_packed(rows, pieces):
    """``pieces`` hold every id of every row once, gapless in their sequences; returns the share of padding."""
    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for ident, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[ident, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        assert p.length > 0
    for (ident, n), own in by_doc.items():
        copies = sum(c for (i, m, _), c in want.items() if (i, m) == (ident, n))
        assert copies and sum(p.length for p in own) == n * copies
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding / max(1, total)


def test_packing_keeps_every_id(documents, table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "it's <|endoftext|> x y 漢字 1234 É́ ﬁ İstanbul don't"), (9003, "word " * 9000), (None, "null id"), (9004, "q" * 5000)]
    pieces = packing.pack(documents(rows), VOCABULARY).collect()
    assert check_packed(rows, pieces) < 0.02
    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    for ident, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p in pieces:
            if p.doc_id == ident:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_sequences_hold_the_ids(documents):
    rows = [(k, "some words here " * (k % 50)) for k in range(120)]
    got = packing.sequences(documents(rows), VOCABULARY).collect()
    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = sum(len(model.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.n_tokens for r in got) == want and sum(r.ids.count(1) for r in got) >= 120
    assert packing.pack(documents([]), VOCABULARY).count() == 0


def test_many_tiny_documents_leave_no_padding(documents):
    rows = [(k, "") for k in range(3000)]
    pieces = packing.pack(documents(rows), VOCABULARY).collect()
    assert check_packed(rows, pieces) == 0 and len({p.sequence_id for p in pieces}) < 12


def test_linear_program_reaches_its_bound():
    sizes, demand = np.array([90, 110, 128, 256]), np.array([400.0, 300.0, 500.0, 40.0])
    found, x = packing.patterns(sizes, demand, room=256, gap=1e-6)
    assert np.allclose(found.T @ x, demand) and (found @ sizes <= 256).all()
    # By size alone: 200 + 150 + 250 + 40 sequences; the total length is a bound from below.
    assert demand @ sizes / 256 <= x.sum() <= 640


# --- pipeline ----------------------------------------------------------------------------------------------

def test_pipeline_stages_match_brute_force(spark):
    from test_text_operators import brute_lines, brute_near

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "near dedup", "mixing", "packing"]

    kept = stages["quality classifier"](spark, docs, data)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, q in marks.items() if q == 1]
    assert kept.columns == names and sum(i in ids for i in clean) > 0.95 * len(clean)

    once = stages["line dedup"](spark, kept, data)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert once.columns == names and sorted(((r.doc_id, r.text) for r in once.collect()), key=str) == sorted(((i, t) for i, _, _, t in brute_lines(rows)), key=str)
    assert all(r.n_chars == len(r.text) for r in once.collect())

    apart = stages["near dedup"](spark, once, data)
    rows = [(r.doc_id, r.text) for r in once.collect()]
    assert apart.columns == names and sorted(r.doc_id for r in apart.collect()) == sorted({c for _, n, c in brute_near(rows, 5) if n} | {i for i, n, _ in brute_near(rows, 5) if not n})

    mixed = stages["mixing"](spark, apart, data)
    assert mixed.columns == names and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    pieces = stages["packing"](spark, mixed, data).collect()
    assert check_packed([(r.doc_id, r.text) for r in mixed.collect()], pieces) < 0.02

    whole = corpus_pipeline.run(spark, data).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)
    tokens = lambda ps: sum(p.length for p in ps)
    assert tokens(whole) == tokens(pieces) and {key(p)[0] for p in whole} == {key(p)[0] for p in pieces}


def test_pipeline_tolerates_odd_rows(spark, documents):
    docs = documents([(1, None), (1, None), (2, ""), (None, "x y z"), (3, "a b c d e f " * 50), (4, "a b c d e f " * 50)])
    out = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, ""), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "3", "None"]  # texts without words link with nothing
    assert corpus_pipeline.mix(spark, out, "").columns == docs.columns
    assert lines.dedup_lines(documents([])).count() == minhash.drop_near(documents([])).count() == 0
