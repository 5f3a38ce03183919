"""Each operator against brute force, exact round trips or held-out accuracy, on edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from parlance.llm import forced_bpe, kd_shard, license_scan, media_ts, mixing, ngram_join, pfp_dedup, queries, rule_ensemble, rule_ledger, style_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_transport_stream_round_trip(docs, texts):
    got = by_id(media_ts.read_back(media_ts.store(docs)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert got[i]["media_bytes"] % 188 == 0 and "cc_errors=0;crc_errors=0;broken=0" in got[i]["feature"]


def test_transport_stream_faults():
    payload = np.arange(64 * 400, dtype=np.uint64).astype(np.uint8)
    media = media_ts.mux(payload).reshape(-1, 188)
    lost = media_ts.demux(np.delete(media, 5, axis=0).reshape(-1))
    assert lost.cc_errors == 1 and sum(u.broken for u in lost.units) == 1
    twice = media_ts.demux(np.insert(media, 5, media[5], axis=0).reshape(-1))
    assert twice.duplicates == 1 and b"".join(u.data for u in twice.units) == payload.tobytes()
    bad = media.copy()
    bad[0, 10] ^= 1
    assert media_ts.demux(bad.reshape(-1)).crc_errors == 1
    units = media_ts.demux(media.reshape(-1)).units
    assert [u.random_access for u in units][:5] == [True, False, False, False, True] and units[1].pts == 7200


def test_shards(docs, texts, empty):
    got = kd_shard.shard(docs, leaves=4).toPandas()
    assert len(got) == len(texts) and set(got["shard"]) <= set(range(4))
    size = got.groupby("shard")["size"].sum()
    assert size.sum() == sum(len((t or "").encode()) + 1 for t in texts)
    assert size.max() - size.sum() / 4 <= got["size"].max()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert kd_shard.shard(empty).count() == 0


def test_shards_divide_one_large_group(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "'s' AS source", "'en' AS lang")
    size = kd_shard.shard(rows).groupBy("shard").count().toPandas()["count"]
    assert len(size) == 16 and size.max() - size.min() <= 4


PAGE = "<html><body><header>H</header><nav><a href=x>menu</a></nav><div class='cookie-notice'>N</div><article><h1>T &amp; t</h1><p>one\n two<br>three<p>four &lt;b&gt;<ul><li>x<li>y</ul><div class='comments'><p>no</p></div></article><aside>s</aside><form>q</form><footer>f</footer><script>var a='</p>'</script>"


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "http://h.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://h.example/2", "<p>plain<p>text<di")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    assert got == {1: "T & t\n\none two three\n\nfour <b>\n\nx\n\ny", 2: "", 3: "", 4: "plain\n\ntext"}
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_style_tree_drops_what_every_page_repeats(spark):
    page = "<body><div class='shell'><p>{}</p></div><div class='strip'><span>Same words on all pages</span></div>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(f"Text number {i}")) for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in style_tree.extract(pages).collect()} == {f"Text number {i}" for i in range(12)}


SHELL = "<body><div class='top'><ul><li>Home page</li><li>News of today</li></ul></div><div class='x{0}'><h1>Title {0}</h1>{1}</div><div class='b'><span>Same words below</span><p>Imprint</p></div></body>"


def brute_tree(pages, prior, main):
    """Importance by the definition, page by page."""
    import math

    found = [style_tree.blocks(h) for h in pages]
    seen, low = {}, set()
    for f in found:
        seen.setdefault(tuple(b.text for b in f), f)
    per = collections.defaultdict(list)
    for f in seen.values():
        for path, pair in style_tree.tree_nodes(f)[0].items():
            per[path].append(pair)
    for path, pairs in per.items():
        m = len(pairs)
        h = [-sum(c / m * math.log(c / m, m) for c in collections.Counter(x[k] for x in pairs).values()) if m > 1 else 1 for k in (0, 1)]
        part = style_tree.DECAY ** len({x[0] for x in pairs})
        if m > 1 and (1 - part) * h[0] + part * h[1] < style_tree.LEAST_IMPORTANCE:
            low.add(path)
    out = []
    for f in found:
        kept = [b for b in f if not (prior and b.noise) and not any(x in low for x in style_tree.branches(b.path))]
        if main and any(b.main for b in kept):
            kept = [b for b in kept if b.main]
        elif prior:
            kept = [b for b in kept if b.linked < style_tree.LINKED_SHARE]
        out.append("\n\n".join(b.text for b in kept))
    return out


def test_style_tree_equals_brute_force_and_entropy_decides(spark):
    """Pages without an article element or telling names: the tree alone finds what they share."""
    bodies = ["".join(f"<p>Words {i} of {k}</p>" for k in range(1 + i % 4)) for i in range(12)]
    pages = [SHELL.format("", b).replace("Title ", f"Title {i}") for i, b in enumerate(bodies)] + [SHELL.format("", bodies[0]).replace("Title ", "Title 0")] * 3
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    texts = lambda **o: [r["text"] for r in style_tree.extract(frame, **o).orderBy("page_id").collect()]
    for prior in (True, False):
        assert texts(prior=prior, main=prior) == brute_tree(pages, prior, prior)
    alone, without = texts(prior=False, main=False), texts(entropy=False)
    assert alone[1] == "Title 1\n\nWords 1 of 0\n\nWords 1 of 1" and all("Home" not in t and "Imprint" not in t for t in alone)
    assert all("Home" in t and "Imprint" in t for t in without)


def test_style_tree_of_real_pages(spark):
    """All pages of a few sites against the definition, with and without the prior on names."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", style_tree._host())
    some = [r["host"] for r in pages.groupBy("host").count().orderBy(F.desc("count"), "host").limit(4).collect()]
    for host in some:
        of_host = pages.where(F.col("host") == host)
        rows = of_host.orderBy("page_id").collect()
        for flag in (True, False):
            got = {r["page_id"]: r["text"] for r in style_tree.extract(of_host, prior=flag, main=flag).collect()}
            assert [got[r["page_id"]] for r in rows] == brute_tree([r["html"] for r in rows], flag, flag)


def test_repeated_pages_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://h.example/1", "<p>a b</p>", "x", 1, 2)] * 3, "page_id long, url string, html string, path string, host int, row_key int")
    assert [r["text"] for r in style_tree.extract(rows).collect()] == ["a b"] * 3


def test_style_tree_keeps_copies_of_a_page(spark):
    page = "<body><article><p>{}</p></article>"
    rows = [(i, f"http://h.example/{i}", page.format("copied article")) for i in range(20)]
    assert {r["text"] for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"copied article"}


def test_repeats(docs, texts, empty):
    got = by_id(pfp_dedup.digest(docs))
    want = pfp_dedup.brute_force([(t or "").encode() for t in texts])
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 0
    assert pfp_dedup.digest(empty).count() == 0


def test_repeats_of_hot_cores(docs, texts):
    """Cores of more than a few phrases go another way, to the same rows."""
    cold = by_id(pfp_dedup.remove(docs))
    hot = by_id(pfp_dedup.remove(docs, hot_forms=1))
    assert all(cold[i] == hot[i] for i in range(len(texts)))


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 3000)) for _ in range(2)]
    texts += [texts[0][:1700] + texts[1][900:2600] + texts[0][200:900], "z" * 2500]
    raw = [t.encode() for t in texts]
    rows = list(enumerate(texts))
    whole = pfp_dedup.brute_force(raw)
    lists = []
    monkeypatch.setattr(pfp_dedup, "PIECE", 500)
    for t in raw:
        buf, offs = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        starts = [shift + i for _, shift, some, at in pfp_dedup.pieces(buf, offs) for lo, hi, _ in [pfp_dedup.runs(some, at, pfp_dedup.bk.Rolling(some))] for a, b in zip(lo, hi, strict=True) for i in range(a, b + 1)]
        lists.append(sorted(starts))
    assert lists == [list(range(len(t) - 399)) for t in raw]
    monkeypatch.undo()
    got = by_id(pfp_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == whole


def test_suffix_order():
    rng = np.random.default_rng(4)
    for turn in range(60):
        letters = [b"ab", bytes(range(97, 123)), bytes(range(256))][turn % 3]
        pick = lambda n: bytes(letters[k] for k in rng.integers(0, len(letters), n))  # noqa: B023, E731
        base = pick(int(rng.integers(1, 900)))
        texts = [pick(int(rng.integers(0, 60))) + base[(a := int(rng.integers(0, len(base)))) : int(rng.integers(a, len(base) + 1))] + pick(int(rng.integers(0, 60))) for _ in range(rng.integers(1, 8))]
        buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        length = [8, 20, 50, 100, 400][turn % 5]
        places = [(int(o) + i, t[i:]) for t, o in zip(texts, offs, strict=False) for i in range(len(t) - length + 1)]
        if places:
            tails = dict(places)
            order = np.array(sorted(tails))[pfp_dedup.suffix_order(buf, offs, np.array(sorted(tails)))]
            assert [tails[p] for p in order.tolist()] == sorted(tails.values())
        times = collections.Counter(t[:length] for _, t in places)
        assert pfp_dedup.repeated_strings(buf, offs, length).tolist() == sorted(p for p, t in places if times[t[:length]] > 1)


def test_licenses(docs, spark):
    texts = list(license_scan.TEMPLATES.values()) + ["nothing", None, "", "x " * 50 + license_scan.TEMPLATES["MIT-text"].replace("Software", "software!") + " y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in license_scan.scan(rows).collect():
        got[r["doc_id"]][r["license"]] = round(r["containment"], 9)
    for i, t in enumerate(texts):
        assert got.get(i, {}) == {k: round(v, 9) for k, v in license_scan.brute_force(t, license_scan.TEMPLATES).items()}
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_notices_inside_long_texts():
    """Short and long notices at the start, in the middle and at the end, whatever stands beside them."""
    rng, index = np.random.default_rng(11), license_scan.Index(license_scan.TEMPLATES)
    for turn, name in enumerate(["MIT"] * 150 + list(license_scan.TEMPLATES)):
        near = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(2)]
        notice = license_scan.TEMPLATES[name]
        for text in (f"{notice} {near[0]}", f"{near[0]} {notice} {near[1]}", f"{near[0]} {notice}"):
            raw = np.frombuffer(text.encode(), np.uint8)
            got = {n: round(share, 9) for n, share, _ in index.scan(license_scan.word_hashes(raw, np.array([0, len(raw)]))[0])}
            assert got == {k: round(v, 9) for k, v in license_scan.brute_force(text, license_scan.TEMPLATES).items()}, (turn, name)


def test_targets():
    got = mixing.targets([100, 10, 50], [3, 1, 2])
    assert got.sum() == pytest.approx(240) and (got <= np.array([200, 20, 100]) + 1e-9).all()
    assert mixing.targets([0, 0], [3, 1]).tolist() == [0, 0]
    quotas = np.array([7, 0, 13, 22])
    shares = mixing.split(quotas, 5)
    assert (shares.sum(axis=1) == quotas).all() and np.ptp(shares.sum(axis=0)) <= 1


def test_mix(docs, texts, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(texts) and (got["taken"] <= 2 * got["size"]).all()
    for i, t in enumerate(texts):
        assert got.loc[got["doc_id"] == i, "size"].item() == len(WORD.findall(t or ""))
    sums = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums["taken"] - sums["target"]) <= 1).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert got.set_index("doc_id")["taken"].sort_index().equals(again.set_index("doc_id")["taken"].sort_index())
    assert mixing.mix(empty).count() == 0


def test_rule_ensemble(spark, docs):
    base = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = rule_ensemble.fit(all_docs, labels)
    got = rule_ensemble.score(all_docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert rule_ensemble.score(docs, model).where("score is null or score < 0 or score > 1").isEmpty()
    none = rule_ensemble.fit(all_docs, labels.limit(0))
    assert not none.rules and none.bias == 0


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    path = queries.byte_vocabulary()
    lib = Tokenizer.from_file(path)
    got = by_id(forced_bpe.digest(docs, path))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    e = forced_bpe.Encoder(path)
    parts = ["a", " ", "  ", "\n", "\n\n", "'s", "é", "à", " ", "　", "<|endoftext|>", "12", ".", "日本", "\t", "\x1c", "\x85", "😀", " ", "Ω"]
    rng = np.random.default_rng(1)
    for _ in range(3000):
        s = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert e.encode(s) == ids and e.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_encode_decode_tables(docs, texts):
    path = queries.byte_vocabulary()
    back = by_id(forced_bpe.decode(forced_bpe.encode(docs, path), path))
    assert [back[i]["text"] for i in range(len(texts))] == [t or "" for t in texts]


def measured(t: str) -> tuple[int, ...]:
    w, t = WORD.findall(t or ""), t or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_ledger(docs, texts, empty):
    more = [*texts, "a\na\n\nb|\na", "\n\n", "x\ny", "# # # #\n# # # #"]
    frame = docs.sparkSession.createDataFrame(list(enumerate(more)), "doc_id long, text string")
    got = by_id(rule_ledger.apply_policy(rule_ledger.ledger(frame)))
    for i, t in enumerate(more):
        n = measured(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n, (i, t)
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (got[i]["base_failed"] and got[i]["kept"])
    book = rule_ledger.ledger(docs)
    cut = {r["rule"]: (r["failed"], r["rejected_by_it_alone"]) for r in rule_ledger.ablation(book).collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    assert cut["too_few_words"] == (sum(b & 1 for b in bits), sum(b == 1 for b in bits))
    assert rule_ledger.ledger(empty).count() == 0
    assert rule_ledger.passing(docs).columns == docs.columns


def joined(texts) -> list[tuple[int, int]]:
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    near = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if near[a] != near[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    near[a] = near[b] = min(near[a], near[b])
                    changed = True
    return [(len(s), n) for s, n in zip(sets, near, strict=True)]


def test_ngram_join(docs, texts, empty):
    got = by_id(ngram_join.join(docs))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == joined(texts)
    assert ngram_join.join(empty).count() == 0


def test_one_of_each(docs, texts):
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted({c for _, c in joined(texts)})


def test_repeated_rows(docs):
    twice = docs.where("doc_id between 9 and 12").union(docs.where("doc_id between 9 and 12"))
    n = twice.count()
    assert pfp_dedup.digest(twice).count() == n and ngram_join.join(twice).count() == n and mixing.mix(twice).count() == n and kd_shard.shard(twice).count() == n
    assert pfp_dedup.digest(twice).where("n_bytes >= 400 and n_removed < n_bytes").isEmpty()


def test_groups_of_nothing_but_empty_texts(spark):
    """Null ids, and partitions that hold only null or empty texts."""
    rows = spark.createDataFrame([(None, None, None, None), (1, "", "s", "en"), (2, " \n", None, "en"), (None, "", "s", None), (3, "a b c d e f g", "s", "en")], "doc_id long, text string, source string, lang string").repartitionByRange(5, "text")
    assert sorted(r["n_words"] for r in rule_ledger.ledger(rows).collect()) == [0, 0, 0, 0, 7]
    assert rule_ledger.passing(rows).count() == 0
    assert rule_ensemble.score(rows, rule_ensemble.Model(0.0, (), ())).where("score = 0.5").count() == 5
    assert media_ts.read_back(media_ts.store(rows)).where("payload_bytes = 64").count() == 5
    assert kd_shard.shard(rows).count() == 5 and mixing.mix(rows).count() == 5
    assert pfp_dedup.digest(rows).where("n_removed = 0").count() == 5
    assert forced_bpe.digest(rows, queries.byte_vocabulary()).count() == 5
    assert license_scan.scan(rows).count() == 0
    joined_rows = ngram_join.join(rows).collect()
    assert sorted(r["n_shingles"] for r in joined_rows) == [0, 0, 0, 0, 3]
    assert ngram_join.one_of_each(rows).count() == 4  # null and empty text are the same text


def test_near_copies_around_a_centre(spark):
    """Copies of one text with edits of their own: linked to the centre, not to each other; and one too far from all."""
    words = [f"c{i}" for i in range(150)]
    texts = [" ".join(words)]
    for k in range(120):
        w = list(words)
        for j in range(1 + k % 7):
            w[(k * 13 + j * 21) % 150] = f"e{k}x{j}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(ngram_join.join(rows))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == joined(texts)


def test_blocks_of_a_long_list_lose_no_partner(spark):
    """Every pair that the filter of sizes and positions lets through meets in some block."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    size = rng.integers(1, 400, 160)
    place = [int(rng.integers(0, max(1, ngram_join.prefix_lengths(np.array([n]))[0]))) for n in size]
    rest = spark.createDataFrame([(1, 160, i, (i, int(n), p)) for i, (n, p) in enumerate(zip(size, place, strict=True))], "h long, size long, label long, m struct<class:long,n:int,pos:int>")
    x, y = rest.select(F.col("m").alias("x")), rest.select(F.col("m").alias("y"))
    want = x.crossJoin(y).where(F.col("x.class") < F.col("y.class")).where(ngram_join._possible("x", "y", 75)).select("x.class", "y.class")
    got = ngram_join._across(rest, 75)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and want.count() > 500
