import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tesserae.llm import common, decontam, html, minhash, packing, pii, quality, queries, sharding, tokens, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = ["", "one", "two words", "The SAME text, The same text", " \t\n", "x" * 50_000, "é中文 ñ " * 300, "a b c d " * 4000, "<|endoftext|> I'm 12 don't", None]


def documents(spark, texts, **extra):
    rows = [(i, t, None if i % 3 else "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = list(EDGE)
    for n in (3, 6, 12, 40, 150):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(n)] = rng.choice(words)
            out.append(" ".join(copy))
    hot = [rng.choice(words) for _ in range(30)]
    for _ in range(60):  # a passage that many share, between other words
        own = [rng.choice(words) for _ in range(rng.randrange(1, 25))]
        out.append(" ".join(own + hot))
    return out


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_minhash(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # several blocks in a bucket
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, corpus, key="k", fp=1, n=2), 4).collect()}
    assert got == brute.near_duplicates(list(enumerate(corpus)))


def test_minhash_recall(spark):
    """Pairs of long texts whose similarity is just at 0.8 and above: at least 99 of 100 are found, and none just below."""
    rng = random.Random(11)
    texts, true = [], []
    for k in range(400):
        n = rng.choice([40, 150, 600])
        base = [f"{k}a{i}" for i in range(n)]
        other, sets = list(base), brute.shingles(" ".join(base))
        goal = 0.80 + 0.05 * rng.random() if k % 4 else 0.70 + 0.095 * rng.random()
        while True:  # words are changed until the similarity falls to the goal
            at = rng.randrange(n)
            kept, other[at] = other[at], f"{k}b{at}"
            mine = brute.shingles(" ".join(other))
            both = len(sets & mine)
            if both < goal * len(sets | mine):
                if k % 4:
                    other[at] = kept
                break
        mine = brute.shingles(" ".join(other))
        texts += [" ".join(base), " ".join(other)]
        true.append(100 * len(sets & mine) >= 80 * len(sets | mine))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), 4).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(len(true))]
    assert sum(true) > 250 and sum(f and t for f, t in zip(found, true)) >= 0.99 * sum(true)
    assert not any(f and not t for f, t in zip(found, true))


def test_minhash_unnamed_partner(spark):
    """A group's member that nobody names as the likeliest partner may still hold the only link to another document."""
    rows = brute.one_link_clusters(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    want = {}
    for at in range(0, len(rows), 102):  # clusters share no word
        want |= brute.near_duplicates(rows[at : at + 102])
    assert sum(kept for _, _, kept in want.values()) == 12 and got == want


def test_minhash_short(spark):
    """Sets of four shingles have few registers: none of them may lie outside all bands."""
    rows = brute.short_pairs(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: (4 + i % 2, i - i % 2, i % 2 == 0) for i, _ in rows}


def test_minhash_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op1_minhash_near_dedup"]).fetchall())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_minhash_near_dedup(spark, SF).collect()) == want


def test_minhash_edges(spark):
    rows = [(7, "a b c d e f g h"), (7, "a b c d e f g h"), (9, "a b c d e f g h"), (None, "a b c d e f g h"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [("3", 3, True), ("4", 4, True), ("7", 7, True), ("7", 7, True), ("9", 7, False), ("None", 7, False)]
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicate(df).collect()) == ["3", "4", "7", "None"]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_estimate():
    rng = np.random.default_rng(1)
    for n, share in ((200, 0.8), (2000, 0.5), (20_000, 0.9)):
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2)
        sides = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64) * np.uint64(2) + np.uint64(k)])) for k in (0, 1)]
        true = len(common) / (2 * n - len(common))
        regs = [minhash.sketch(minhash._mix(s.copy())[np.argsort(minhash._mix(s.copy()))]) for s in sides]
        j = minhash.estimate(regs[0][None], regs[1][None], np.array([n]), np.array([n]))[0]
        assert abs(j - true) < 0.2


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"q{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((3, 13, 30, 20))] + [(8, "Short One"), (9, ""), (10, None)]
    texts = list(EDGE) + [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
    texts += [f"X-{items[2][1].upper()}! tail", items[0][1], items[3][1] + " " + " ".join(["pad"] * 500), "short, one; short ONE"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, hits=1, n_words="x")
    for most in (decontam.MOST_BYTES, 150):  # one automaton and several
        found = decontam.benchmark_hits(docs, bench, most_bytes=most).selectExpr("*", f"{decontam.CONTAMINATED} AS c").collect()
        for r in found:
            digest = hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
            assert (r["n_words"], len(r["hits"]), len(r["items"]), digest, r["c"]) == brute.contamination(texts[r["doc_id"]], items)
            if r["spans"] and r["text"].startswith("X-"):
                assert r["text"][r["spans"][0]["start"] : r["spans"][0]["end"]] == items[2][1].upper()
        kept = decontam.decontaminate(docs, bench, most_bytes=most)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["c"]}
    assert decontam.benchmark_hits(docs.where("false"), bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_automaton():
    """Texts against brute force: few words, so that runs overlap and repeat; items made from one template, repeated ids, a wide vocabulary."""
    rng = random.Random(5)
    for size, window in ((3, 4), (12, 13), (3000, 13), (6, 1), (6, 2)):
        words = [f"w{i}" for i in range(size)]
        template = rng.choices(words, k=30)
        items = [(k % 25, " ".join(rng.choices(words, k=rng.randrange(0, 3 * window)))) for k in range(40)]
        items += [(100 + k, " ".join([*template, str(k), *template])) for k in range(10)]
        machine = decontam.Machine([(i, t.encode()) for i, t in items], window)
        for _ in range(60):
            text = " ".join(rng.choices(words, k=rng.randrange(40)))
            if rng.random() < 0.7:
                part = rng.choice(items)[1].split()
                at = rng.randrange(len(part) + 1)
                text += " - " + " ".join(part[at : at + rng.randrange(3 * window)]).upper() + " x " + text
            n, hits, found = machine.scan(text.encode())
            digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (n, len(hits), len(found), digest) == brute.contamination(text, items, window)[:4]


def test_automaton_of_large_benchmark():
    """A benchmark of 4 MB: the automaton takes less than 100 bytes for each of its bytes, and finds what it should."""
    rng = random.Random(9)
    words = [f"term{i}" for i in range(40_000)]
    items = [(k, " ".join(rng.choices(words, k=50)).encode()) for k in range(9_000)]
    assert sum(len(t) for _, t in items) > 4_000_000
    machine = decontam.Machine(items)
    assert machine.automaton.get_stats()["total_size"] < 100 * sum(len(t) for _, t in items)
    for k in (0, 4321, 8999):
        part = items[k][1].split()[20:35]
        assert machine.scan(b"a b " + b" ".join(part) + b" c") == (18, list(range(2, 17)), [k])
        assert machine.scan(b" ".join(part[:12])) == (12, [], [])


def test_token_files(spark, corpus, ids_of):
    rows = [(i, t) for i, t in enumerate(corpus)] + [(5, "again five"), (5, "again five"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tokens.round_trip(df).collect(), key=lambda r: r["start"])
    at, order = 0, []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        order.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert order == sorted(order)
    want = sorted((-1 if i is None else i, len(ids_of(t)) + 1, brute.crc(ids_of(t) + [1])) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tokens.round_trip(df.where("false")).count() == 0


def test_token_files_prune(spark, tmp_path):
    path = f"file://{tmp_path}/orc"
    tokens.write_orc(spark.read.parquet(f"{SF}/documents.parquet"), path)
    one = tokens.read_orc(spark, path).where("doc_id = 77")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()


def test_encoder(ids_of):
    own = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = "aAeEéÉñßüÜçœŒ中İſ1 ’'\"-.,!?$ \t\n \u0085　́"
    texts = [t or "" for t in EDGE] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == ids_of(t)


def test_other_vocabulary():
    """A file with other steps before its model is encoded whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not own.by_chunk and tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY)).by_chunk
    for text in ("Two  words, and 12 more\n\tline", "É", "", " x"):
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_generations(ids_of, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice("the of And, x1 zebra's Über quilt! a b c d e f g".split()) for _ in range(6))
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == ids_of(text)
        assert len(own.chunks) < 20 and len(own.chunks.old) < 20


@pytest.mark.parametrize("windows", [1, 4, 64])
def test_packing(spark, corpus, ids_of, windows):
    df = documents(spark, corpus, offset=1, start="x").repartition(3)
    rows = packing.pack(df, open_windows=windows, length=256).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(corpus):
        ids, at = ids_of(t) + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    fill = sum(r["length"] for r in rows) / (256 * len(sequences))
    assert fill > 0.97
    assert packing.pack(df.where("false")).count() == 0


def test_sharding(spark, corpus):
    texts = corpus * 3 + ["hot text " * 9] * 150
    rows = [r.asDict() for r in sharding.kd_shards(documents(spark, texts, node=3, size="s"), 16).collect()]
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    sizes = {}
    for s in range(16):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in own)
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2.5 * largest
    assert sharding.kd_shards(documents(spark, ["", None, "one"]), 16).count() == 3
    assert sharding.kd_shards(documents(spark, ["x"]).where("false"), 16).count() == 0


def tree(rows, shards, slack, leaf, first=0):
    """Shards of points by recursion: {row number: shard}. rows: (number, size, dimensions, checksum, salt)."""
    if shards == 1 or not rows:
        return {r[0]: first for r in rows}
    d = max(range(3), key=lambda k: max(r[2][k] for r in rows) - min(r[2][k] for r in rows))
    goal = sum(r[1] for r in rows) * (shards // 2) / shards

    def median(order, goal):
        below = 0
        keys = sorted({order(r) for r in rows if order(r) is not None})
        for v in keys:
            at = sum(r[1] for r in rows if order(r) == v)
            if below + at > goal or v == keys[-1]:
                return v, below, at
            below += at

    key = lambda r: (r[2][d], r[3])
    v, below, at = median(key, goal)
    if min(goal - below, below + at - goal) <= slack * leaf:
        right = [r for r in rows if key(r) > v or key(r) == v and below + at - goal >= goal - below]
    else:
        goal -= below
        s, below, at = median(lambda r: r[4] if key(r) == v else None, goal)
        right = [r for r in rows if key(r) > v or key(r) == v and (r[4] > s or r[4] == s and below + at - goal >= goal - below)]
    gone = {r[0] for r in right}
    return tree([r for r in rows if r[0] not in gone], shards // 2, slack, leaf, first) | tree(right, shards - shards // 2, slack, leaf, first + shards // 2)


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_sharding_by_hand(spark, corpus, shards):
    """Against a tree grown by recursion over the same points; copies share a point, whatever their source."""
    df = documents(spark, corpus * 2 + ["copy of a text"] * 40)
    stretched, _ = sharding.shared_points(sharding.stored(sharding.points(df), "points")[0])
    held = [(k, r["size"], tuple(r[d] for d in sharding.DIMENSIONS), r["text_crc32"], r["salt"], r["doc_id"]) for k, r in enumerate(stretched.collect())]
    assert all(max(r[2][k] for r in held) == (1 << sharding.BITS) - 1 and min(r[2][k] for r in held) == 0 for k in range(3))
    assert len({r[2] for r in held if r[3] == zlib.crc32(b"copy of a text")}) == 1
    want = tree(held, shards, sharding.SLACK, sum(r[1] for r in held) / shards)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(df, shards).collect()}
    assert got == {held[k][5]: s for k, s in want.items()}


def test_sharding_repeated_rows(spark):
    """One id and one text, and null ids, in most rows: shards still hold nearly equal bytes."""
    rows = [(7, "the same text again")] * 900 + [(None, "no id")] * 900 + [(k, None) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.kd_shards(df, 16).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16 + 2 * 20
    for s in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>tag, line, with, commas</p></header><nav><a href=/>x</a></nav><div id="cookie-notice"><p>We, use, cookies, a, lot</p></div>
    <div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>First para, with <a href=x>link</a>
    text<br>and more.</p><div class="ad">Buy, now</div><p>Second &lt;b&gt; para, good.<ul><li>one<li>two</ul><form><p>name, mail</p></form><script>var t="</p>";</script></div><div class="sidebar"><p>Side, text, here</p></div></div>
    <section id="comments"><p>Nice, post, thanks, a, b, c, d, e, f, g</p></section><footer>f</footer>"""
    assert html.extract(page) == "Title & more\nFirst para, with link text and more.\nSecond <b> para, good.\none\ntwo"
    assert html.extract(None) == html.extract("") == html.extract("<p>") == ""
    assert html.extract("plain &eacute;  text") == "plain é text"
    assert html.extract("<div>" * 20_000 + "deep, text") == "deep, text"
    assert html.extract("<article><p>a<p>b</article><footer>c") == "a\nb"


LEDE = "The council met on Monday, and after a long debate, with many speakers, it agreed on the plan for the old harbour."
MORE = "Work begins in spring, said the mayor, who had asked for patience, money, and good weather. The bridge, the quay and the sheds will stay, as the town wished."
LAST = "Opponents, among them traders and fishers, announced that they would go to court, if need be, to the highest one."
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in "home news sport culture weather".split())
STORY = f"<p>{LEDE}</p><p>{MORE}</p><p>{LAST}</p>"
TEXT = f"{LEDE}\n{MORE}\n{LAST}"
REMARKS = "".join(f"<li><p>I, for one, think that this, whatever they say, is a shame, a waste, and an insult, number {k}.</p></li>" for k in range(12))
#: (html, main text), marked by hand.
MARKED = [
    (f"<body><nav><ul>{LINKS}</ul></nav><article>{STORY}</article><footer>&copy; us</footer>", TEXT),
    (f"<body><article><div class='article-header'><h1>Plan</h1><p>{LEDE}</p></div><div class=body><p>{MORE}</p><p>{LAST}</p></div></article>", f"Plan\n{TEXT}"),
    (f"<body><article><p>{LEDE}</p><p class='market-share'>{MORE}</p><p>{LAST}</p></article>", TEXT),
    (f"<body><div id=main><p>{LEDE}</p><div class='search-party'><p>{MORE}</p></div><p>{LAST}</p></div>", TEXT),
    (f"<body><form action=/ method=post><input name=q><select><option>one, two</option></select><div id=content>{STORY}</div></form>", TEXT),
    (f"<body><article><p>{LEDE}</p><p class=\"x>{MORE}</p><p class=\"y\">{LAST}</p></article>", TEXT),
    (f"<body><article><p>{LEDE}</p><p title='x>{MORE}</p><p>{LAST}</p></article>", TEXT),
    (f"<body><article>{STORY}<section class='responses'><h3>Responses</h3><ol>{REMARKS}</ol></section></article>", TEXT),
    (f"<body><article>{STORY}<section><h3>12 comments</h3><ul>{REMARKS}</ul></section></article>", TEXT),
    (f"<body><article>{STORY}<div>{''.join(f'<article><p>Shame, shame, shame, and number {k}, again.</p></article>' for k in range(9))}</div></article>", TEXT),
    (f"<body><div class=story>{STORY}</div><div id='disqus_thread'><ul>{REMARKS}</ul></div>", TEXT),
    (f"<body><header class=masthead><h1>The Herald</h1><p>News, views, and more, since 1901, every day of the week, all the year</p></header><main><h1>Plan</h1>{STORY}</main>", f"Plan\n{TEXT}"),
    (f"<body><main><header><h1>Plan</h1></header>{STORY}<footer><p>Filed under: town, harbour, plan</p></footer></main>", f"Plan\n{TEXT}"),
    (f"<body><table><tr><td><ul>{LINKS}</ul></td><td>{STORY}</td></tr></table>", TEXT),
    (f"<body><div class='content-sidebar-wrap'><div class=content>{STORY}</div><div class=sidebar><p>Also, look here, there, and elsewhere, please</p></div></div>", TEXT),
    (f"<body class='nav-open'><div class=wrapper><div class=post>{STORY}</div><aside><p>By the way, this, that</p></aside></div>", TEXT),
    (f"<body><div>{STORY}</div><div class='cookie-notice'><p>We use cookies, as everybody does, for this, that, and more, much more, than you would think possible at all.</p></div>", TEXT),
    (f"<body><article><p>{LEDE}</p><div class=ad><p>Buy, buy, buy now</p></div><p>{MORE}</p><div class='share-buttons'><a href=/f>Share</a> <a href=/g>Send</a></div><p>{LAST}</p></article>", TEXT),
    (f"<body><article><section><h2>One</h2><p>{LEDE}</p></section><section><h2>Two</h2><p>{MORE}</p><p>{LAST}</p></section></article>", f"One\n{LEDE}\nTwo\n{MORE}\n{LAST}"),
    (f"<body><div><h1>Plan</h1><p>{LEDE}</p><ul><li>the bridge<li>the quay</ul><blockquote>{MORE}</blockquote></div>", f"Plan\n{LEDE}\nthe bridge\nthe quay\n{MORE}"),
    (f"<body><div>{LEDE}<br>{MORE}</div>", f"{LEDE} {MORE}"),
    (f"<body><article><pre>a  b\n c</pre>{STORY}</article>", f"a b c\n{TEXT}"),
    (f"<body><div hidden><p>{LAST}</p></div><div style='DISPLAY: none'><p>{LAST}</p></div><div>{STORY}</div>", TEXT),
    (f"<body><div role=navigation><ul>{LINKS}</ul></div><div role=main>{STORY}</div><div role=contentinfo><p>Us, them, and you</p></div>", TEXT),
    (f"<body><article><p>{LEDE}<script>if (a<b) document.write('<p>no</p>')</script></p><style>p:after {{ content: ', ' }}</style><noscript><p>No script</p></noscript><p>{MORE}</p></article>", f"{LEDE}\n{MORE}"),
    (f"<body><article><p data-x='<b>no</b>' onclick=\"if (a > b) f()\">{LEDE}</p><p>{MORE}</p></article>", f"{LEDE}\n{MORE}"),
    (f"<body><article><p>Fish &amp; chips, 3 &lt; 4, &eacute;t&#233;, &nbsp; and so on</p><p>{LEDE}</p></article>", f"Fish & chips, 3 < 4, été, and so on\n{LEDE}"),
    (f"<body><div class='newsletter'><form><p>Your mail, your name, your town, your dog</p><input></form></div><div class=entry>{STORY}</div>", TEXT),
    (f"<BODY><DIV CLASS=Content><P>{LEDE}<P>{MORE}<P>{LAST}</DIV><DIV CLASS=Footer><P>End, finally, at last", TEXT),
    (f"<body><div id=a><div><h1>Plan</h1></div><div>{STORY}</div></div>", f"Plan\n{TEXT}"),
    (f"<body><article><h1>Plan</h1>{STORY}<aside><p>Aside, a box, with facts</p></aside><ul><li><a href=/1>source one</a></li></ul></article>", f"Plan\n{TEXT}\nsource one"),
    ("<body><p>Only, one</p>", "Only, one"),
    (f"<body><article><!-- <p>no</p> -->{STORY}<!-- unclosed <p>no", TEXT),
    (f"<body><article>{STORY}<p>1 < 2 and 3 > 2</p></article", f"{TEXT}\n1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize("case", range(len(MARKED)))
def test_html_marked(case):
    page, text = MARKED[case]
    assert html.extract(page) == text


def test_html_pages(spark):
    """Pages of the tables: an article's blocks, read by another parser; repeated rows, null pages and other columns named like those returned."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = 0, [""]

        def handle_starttag(self, tag, _):
            self.inside += tag == "article"
            if tag in ("p", "h1", "h2", "h3", "ul", "li", "div", "article"):
                self.parts.append("")
            elif tag == "br":
                self.parts[-1] += " "

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in ("p", "h1", "h2", "h3", "ul", "li", "div", "article"):
                self.parts.append("")

        def handle_data(self, data):
            if self.inside:
                self.parts[-1] += data

    def by_hand(page):
        a = Article()
        a.feed(page)
        a.close()
        return "\n".join(x for x in (" ".join(p.split()) for p in a.parts) if x)

    df = spark.read.parquet(f"{SF}/pages.parquet")
    df = df.union(df.limit(5)).union(spark.createDataFrame([(900_000, None, None), (None, "u", "")], df.schema)).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    want = sorted((r["page_id"] or -1, r["url"] or "", by_hand(r["html"] or "")) for r in df.collect())
    rows = html.main_text(df).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "", r["text"]) for r in rows) == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html.main_text(df.where("false")).count() == 0


def test_pii(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y+z@d-e.co.uk", "@", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "é中", " ", ",", "12", "a_b%", "."]
    texts = list(EDGE) + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["9" * 40_000, "a" * 40_000 + "@", "mail a@b.c-d@e.f a@b.c_d@e.f"]
    df = documents(spark, texts, email=1, key="k", term=2)
    for r in pii.find(df).collect():
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in pii.KINDS} == brute.personal(texts[r["doc_id"]])
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    out = {r["doc_id"]: r for r in clean.collect()}
    assert len(out) == len(texts) and out[9]["text"] is None
    assert out[len(texts) - 1]["text"].startswith("mail [EMAIL]")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] and r["doc_id"] > 9)
    assert pii.sanitise(df.where("false")).count() == 0


def disclosed(texts, support=3, bits=4.0, generalise=0.6):
    """Words that give a base match away, by brute force: {word: disclosure}."""
    def words(t):
        return re.findall(r"[^\W\d_]+", t.lower())

    body, own, near, settings = {}, {}, {}, {}
    for t in {t or "" for t in texts}:
        body[t] = set(words(t))
        spans = sorted(s for k in brute.personal(t).values() for s in k)
        own[t] = {t[a:b].lower() for a, b in spans}
        cut = "".join(" " if any(a <= i < b for a, b in spans) else c for i, c in enumerate(t))
        w = words(cut)
        near[t] = set(w)
        for k, x in enumerate(w):
            settings.setdefault(x, {}).setdefault(t, set()).add((w[k - 1] if k else None, w[k + 1] if k + 1 < len(w) else None))
    n_value = {e: sum(e in v for v in own.values()) for v in own.values() for e in v}
    live = {e for e, n in n_value.items() if n >= support and math.log2(len(body) / n) >= bits}
    out = {}
    for x in settings:
        mine = [t for t in near if x in near[t] and own[t] & live]
        if len({s for t in mine for s in settings[x][t]}) < support:
            continue
        for e in live:
            both = sum(e in own[t] for t in mine)
            p = both / sum(x in w for w in body.values())
            if both >= support and p >= generalise and math.log2(p * len(body) / n_value[e]) >= bits:
                out[x] = max(out.get(x, 0), p)
    return out


def test_pii_terms(spark):
    """A word that stands with one address in several texts gives it away, however far off; common words, words of two addresses and words of copies of one passage don't."""
    pad = " ".join(["the plan of the year and the team"] * 200)
    texts = [f"the zorblatt wrote {n} {pad} to kim@corp.com about the plan number {n} of the year" for n in ("one", "two", "three", "four")]
    texts[0] = texts[0].replace("the zorblatt wrote", "zorblatt")
    texts[1] = texts[1].replace("zorblatt wrote", "zorblatt met")
    texts += [f"the plan of {n} the year and the team" for n in "abcdefghijklmnopqrstuvwxyz"] * 3 + [f"the team mails u{k}@x.org and the rest" for k in range(90)]
    texts += [f"team {k} a quirfel passage, lee@corp.com {k}" for k in range(5)] + [f"{n} is wembley kim@corp.com and lee@corp.com" for n in ("no", "yes", "perhaps", "never")]
    docs = documents(spark, texts, key="k", own=1, marks="m", term=2)
    found = {r["doc_id"]: r["term"] for r in pii.find(docs).collect()}
    want = disclosed(texts)
    assert "zorblatt" in want and not {"the", "team", "plan", "quirfel"} & set(want)
    for i, t in enumerate(texts):
        got = {(t[s["start"] : s["end"]].lower(), s["removed"]) for s in found[i]}
        base = [s for k in brute.personal(t).values() for s in k]
        assert got == {(m[0].lower(), want[m[0].lower()] >= pii.REMOVE) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in base)}
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and "zorblatt" not in clean.where("doc_id = 0").first()["text"]


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(i, [0.5] * 8) for i in range(1000, 1300)]
    rows += [(500, None), (600, []), (700, [1.0, None] * 4), (800, [float("nan")] * 8), (900, [float("inf")] * 8), (None, [1.0] * 8), (2000, [1.0, 2.0]), (2001, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(5)
    for block, part in ((topk.BLOCK_BYTES, topk.PART), (300, 1), (100_000, 2)):  # one block and several, in parts
        monkeypatch.setattr(topk, "PART", part)
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, block_bytes=block).collect()))
        assert got == brute.top(rows)
    for scale in (1e5, 1e6, 5e6):  # sums beyond 2^53, and squared norms beyond 2^63 of vectors whose scores fit
        rows = [(0, [scale, 1.0]), (1, [2.0, -scale]), (2, [1.0, 3.0]), (3, [-1.0, scale / 2]), (4, [1.0, 3.0])]
        big = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.top_k(big, F.col("vec_id") == 0, k=3).collect())) == brute.top(rows, 3)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def labelled(spark, n=400):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "ne", "so", "ti", "mu")]
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice(words) for _ in range(rng.randint(3, 20))]
            if toxic:
                w[0] = rng.choice(["vilkor", "vilkant", "grubb"])
            lines.append(" ".join(w) + "." if good else " ".join(x + "###" for x in w))
        docs.append((i, "\n".join(lines)))
        labels.append((i, good, toxic))
    docs += [(n, None), (n + 1, ""), (n + 2, "women and men")]
    labels += [(n + 9, 1, 0), (None, 1, 1), (1, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module, name", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, name):
    docs, labels, known = labelled(spark)
    docs = docs.withColumn("label", F.lit("x")).withColumn("x", F.lit(1))
    model = module.train(docs, labels, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r["s"] for r in module.scored(docs, model, "s").collect()}
    truth = {i: t if name == "toxic" else q for i, q, t in known if i is not None and i < 400 and q is not None}
    held = [i for i in truth if i % 2]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    assert module.scored(docs.where("false"), model, "s").count() == 0
    none = module.train(docs, labels.where("false"), F.lit(True))
    assert {r["s"] for r in module.scored(docs, none, "s").collect()} == {0.5}


def test_toxicity_by_hand(spark):
    """Scores by plain sums of weights; repeated rows, long texts and texts of the same words score alike; identity terms move no score."""
    docs, labels, _ = labelled(spark)
    long = "women and men " * 30_000 + "grubb"
    extra = [(3, long), (3, long), (700, "grubb men women and"), (None, "grubb and men and women"), (701, "muslim teachers sing"), (702, "jewish teachers sing"), (703, "teachers sing")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.scored(docs.withColumn("__score", F.lit("x")), model, "s").collect()
    for r in rows:
        found = toxicity.features(set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))) & set(model.weights)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-(model.intercept + sum(model.weights[f] for f in found)))), abs=1e-9)
    assert len({r["s"] for r in rows if r["text"] and set(r["text"].split()) == {"grubb", "men", "women", "and"}}) == 1
    by = {r["doc_id"]: r["s"] for r in rows}
    assert abs(by[701] - by[703]) < 0.02 and abs(by[702] - by[703]) < 0.02


def test_counterfactual():
    """A term that only goes along with the label loses its weight when pairs that exchange it are held to one score."""
    x = [[1]] * 30 + [[0]] * 10 + [[]] * 30 + [[2]] * 10 + [[1, 2]] * 2
    y = np.array([1.0] * 40 + [0.0] * 42)
    pairs = [([1], [3])] * 30 + [([1, 2], [3, 2])] * 2
    free, _ = toxicity.fit_logistic(x, y, [], 4)
    held, _ = toxicity.fit_logistic(x, y, pairs, 4, weight=5.0)
    assert free[1] - free[3] > 2 and abs(held[1] - held[3]) < 0.2 * (free[1] - free[3])


def test_counterfactual_of_long_texts():
    """Few pairs that differ in many features: the loss falls from step to step instead of growing without end."""
    rng = np.random.default_rng(4)
    x = [sorted(set(rng.integers(0, 60, 20).tolist())) for _ in range(80)]
    y = (rng.random(80) < 0.4).astype(float)
    pairs = [(list(range(0, 30)), list(range(30, 60)))]
    losses = []
    for steps in (0, 40, 400, 4000):
        w, b = toxicity.fit_logistic(x, y, pairs, 60, steps=steps)
        z = np.array([w[r].sum() + b for r in x])
        losses.append(np.mean(np.logaddexp(0, z) - y * z) + (w[:30].sum() - w[30:].sum()) ** 2 + toxicity.L1 * np.abs(w).sum())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.1
    assert toxicity.counterfactual("All women vote. No one else.") != toxicity.words_of("All women vote. No one else.")
    assert toxicity.counterfactual("nothing here") is None


def test_field_marginals():
    """Forward and backward passes against all label chains."""
    rng = np.random.default_rng(3)
    pair, sizes = rng.normal(size=(2, 2)), np.array([5, 3, 1])
    emission = rng.normal(size=9)
    odds, expected = quality.marginals(emission, sizes, pair)
    total, at = np.zeros((2, 2)), 0
    for n in sizes:
        p, z, joint = np.zeros(n), 0.0, np.zeros((2, 2))
        for chain in range(1 << n):
            y = [(chain >> t) & 1 for t in range(n)]
            w = np.exp(sum(e * v for e, v in zip(emission[at : at + n], y)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        np.testing.assert_allclose(1 / (1 + np.exp(-odds[at : at + n])), p / z)
        total += joint / z
        at += n
    np.testing.assert_allclose(expected, total)


def chain(model, own, lengths):
    """Score of one document, line after line."""
    n, w, pair = len(own), model.weights, model.pair
    first = np.concatenate(([0], np.cumsum(quality.SIZES)[:-1]))
    emission = []
    for t in range(n):
        e = sum(w[first + own[t]])
        e += sum(w[quality.N_OWN + first + own[t - 1]]) if t else 0
        e += sum(w[2 * quality.N_OWN + first + own[t + 1]]) if t + 1 < n else 0
        emission.append(e + w[3 * quality.N_OWN + (2 if n == 1 else 0 if t == 0 else 1)] * (t in (0, n - 1)))
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        before = np.logaddexp(*(alpha[t - 1][:, None] + pair)) if t else np.zeros(2)
        alpha[t] = before + [0, emission[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp(*(pair + [0, emission[t + 1]] + beta[t + 1]).T)
    odds = np.diff(alpha + beta, axis=1)[:, 0]
    mean = np.average(1 / (1 + np.exp(-odds)), weights=lengths)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return 1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.shift)))


def test_quality_by_hand(spark):
    """The query's scores against plain recursions over whole texts, long ones and repeated rows among them."""
    docs, labels, _ = labelled(spark)
    rng = random.Random(8)
    long = "\n".join(" ".join(rng.choice(["ba", "do", "x###"]) for _ in range(rng.randint(1, 9))) for _ in range(5000))
    docs = docs.union(spark.createDataFrame([(2, long), (600, long), (600, long), (601, "\n" * 70), (None, "a")], docs.schema)).cache()
    model = quality.train(docs, labels, F.lit(True))
    assert model is not None
    for r in quality.scored(docs, model, "s").collect():
        own, lengths = quality.document_features(r["text"].encode() if r["text"] else None)
        assert len(own) == len((r["text"] or "").split("\n"))
        assert r["s"] == pytest.approx(chain(model, own, lengths), abs=1e-6)


def test_query_columns(spark):
    """Each query runs on the smallest tables, has the columns of its contract, and a row for each document or page, or more where it has pieces or ranks."""
    columns = {
        "op1": "doc_id n_shingles component_id kept", "op2": "doc_id held_out score predicted", "op3": "query_id rank vec_id score", "op4": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5": "doc_id start n_tokens ids_crc32",
        "op6": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7": "doc_id size text_crc32 law shard slot grown_shard", "op8": "doc_id held_out score predicted", "op9": "page_id url text n_chars", "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, f in queries.QUERIES.items():
        out = f(spark, SF)
        op = name.split("_")[0]
        assert set(columns[op].split()) <= set(out.columns), name
        n = spark.read.parquet(f"{SF}/{'pages' if op == 'op9' else 'documents'}.parquet").count()
        assert (out.count() >= n if op == "op6" else out.count() > 0 if op == "op3" else out.count() == n), name


def test_toxicity_features_to_driver(spark, monkeypatch):
    """The best features are chosen in the cluster: no partition sends the driver its own list."""
    frame, plans = type(spark.range(1)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.train(docs.select("doc_id", "text"), labels, F.lit(True)).weights
    assert plans and not any("TakeOrdered" in p for p in plans)


def test_driver_released(spark):
    assert "rim" in common.driver_released(spark)
