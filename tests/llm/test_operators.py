"""Each operator against brute force on a small table with nulls, empty and long texts, ties,
repeated rows and clashing column names; and on empty tables."""

from __future__ import annotations

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from gridsla.llm import html, langid, mixing, neighbours, packing, quality, sharding, simhash, suffixes, toxicity
from gridsla.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, copy string, quality string"
WORDS = "the a of stone river light walks under seven bridges and sings to old trees".split()
random.seed(5)


def sentence(n: int) -> str:
    return " ".join(random.choice(WORDS) + str(random.randint(0, 40)) for _ in range(n))


PASSAGE = sentence(30)
TEXTS = [None, "", "  \n\t", "x", "idiot", "Ünïcode — 世界 " * 30, sentence(60), sentence(200), PASSAGE + " " + sentence(40),
         sentence(20) + " " + PASSAGE, "tie", "tie", "same line\n" * 30, "a" * 300, sentence(6_000),
         "<|endoftext|> a  b \n c's 12  ", "*** | ### " * 40]
TEXTS += [TEXTS[7]] * 4 + [TEXTS[7] + " end"]
ROWS = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None][i % 3], None, "x", "y", "z") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[6], (None, "no id", "en", "s0", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 1, 0), (12, 0, 0), (16, 0, 1), (4, 0, 1), (None, None, None)],
                                 "doc_id long, quality int, toxic int")


def test_mixing_follows_the_poisson_counts(spark, docs, empty):
    got = mixing.mix_sources(docs)
    rates = {r.source: (r.rate, r.cdf) for r in mixing.repetition_rates(docs).collect()}
    times = Counter(r[0] for r in ROWS)
    want = Counter()
    for r in ROWS:
        if r[0] is None or times[r[0]] > 1:
            continue  # numbered by row: see test_mixing_rows
        u = (int(hashlib.md5(f"42:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = np.exp(-rates[r[3]][0])
        k = 0
        while c < u and k < 10_000:
            k += 1
            p *= rates[r[3]][0] / k
            c += p
        want[(r[0], r[1])] += k
    assert Counter((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None and times[r.doc_id] == 1) == +want
    assert set(docs.columns) <= set(got.columns) and got.columns.count("copy") == 1
    assert mixing.mix_sources(empty).count() == 0
    only = mixing.mix_sources(docs, weights={"s1": 1.0}, max_broadcast_rows=0)  # also without a broadcast
    assert {r.source for r in only.select("source").distinct().collect()} <= {"s1"}


def test_mixing_equals_its_sql(spark, tmp_path, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plain.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = Counter(map(tuple, mixing.op1_mixing(spark, str(tmp_path)).collect()))
    assert got == Counter(con.execute(mixing.OP1_SQL).fetchall())


def test_packing_is_an_exact_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, window=256).collect()
    want = Counter()
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 256):
            want[(r[0], s, tuple(ids[s:s + 256]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens) for r in rows) == want
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_decreasing_matches_a_plain_search():
    for seed in range(30):
        rnd = random.Random(seed)
        lengths = [rnd.randint(1, 64) for _ in range(200)]
        bins, offsets, made = packing.best_fit_decreasing(lengths, 64)
        room: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in room if r >= n]
            if fit:
                room[room.index(min(fit))] -= n
            else:
                room.append(64 - n)
        assert made == len(room)
        assert sorted(64 - r for r in room) == sorted(sum(n for n, b in zip(lengths, bins) if b == k) for k in range(made))


def test_quality_counts(docs, labels, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.score_quality(docs, labels).select("doc_id", "quality.*").collect())
    want = Counter()
    for r in ROWS:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
              len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))] += 1
    assert got == want
    assert quality.score_quality(empty, labels).count() == 0
    kept = {r.doc_id for r in quality.score_quality(docs, labels.limit(0)).where("quality.kept").collect()}
    assert {6, 7, 8} <= kept  # no labels: every text that passes the base rules


def test_quality_ratio_equals_brute_force(spark, docs, labels):
    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [x % quality.BUCKETS for x in h] + [(a ^ (b << 1)) % quality.BUCKETS for a, b in zip(h, h[1:])]
    raw, good = Counter(), Counter()
    for r in ROWS:
        raw.update(buckets(r[1]))
        if r[0] in (6, 7, 8):
            good.update(buckets(r[1]))
    n_raw, n_good, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    weight = {k: round(1e6 * (np.log((good[k] + 1) / (n_good + b)) - np.log((raw[k] + 1) / (n_raw + b)))) for k in raw}
    for bound in (quality.MAX_BROADCAST_ROWS, 0):  # with a broadcast of the target's ids, and without
        scored = quality.score_quality(docs, labels, max_broadcast_rows=bound).select("doc_id", "text", "quality.llr").collect()
        assert len(scored) == len(ROWS)
        for r in scored:
            own = buckets(r.text)
            assert r.llr == (sum(weight[k] for k in own) // len(own) if own else None)


def simhash_of(text):
    words = (text or "").encode().lower().split()
    spans = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in keys:
        for b in keys:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash_components(docs, empty):
    got = simhash.simhash_components(docs).collect()
    fps = {simhash_of(r[1]) for r in ROWS}
    root = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict[int, int] = {}
    for r in ROWS:
        if r[0] is not None:
            c = root[simhash_of(r[1])]
            least[c] = min(r[0], least.get(c, r[0]))
    want = Counter((r[0], simhash_of(r[1]), least[root[simhash_of(r[1])]]) for r in ROWS if r[1] != "no id")
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.fp % (1 << 64) != simhash_of("no id")) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_general_pigeonhole_finds_every_connection(spark):
    """Random fingerprints with near copies, a crowded ball and skewed bits."""
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) & 0xFFFF0FFFFFFF00FF for _ in range(300)]
    for f in list(fps[:100]):
        fps.append(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
        fps.append(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(distinct).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in links)
    got = {r.id: r.component for r in connected_components(simhash.near_links(distinct)).collect()}
    x = np.array(fps).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 2):
            parent[find(int(i + 1 + j))] = find(i)
    groups: dict[int, list] = {}
    for i in range(len(x)):
        groups.setdefault(find(i), []).append(fps[i])
    assert {f: min(g) for g in groups.values() if len(g) > 1 for f in g} == got


def test_suffixes_against_brute_force(docs, empty):
    order = sorted({(2**62 if r[0] is None else r[0], r[1]) for r in ROWS if r[1] is not None})
    seen, want = set(), {}
    for ident, text in order:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        want[(ident, len(data))] = bytes(x for x, g in zip(data, gone) if not g)
    got = suffixes.cut_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ident = 2**62 if r.rest.doc_id is None else r.rest.doc_id
        assert bytes(r.kept) == want.get((ident, r.n_bytes), b"")
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
    assert suffixes.cut_repeats(empty).count() == 0


def test_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(60, 12))
    vectors = np.concatenate([base, base[:20] + 0.03 * rnd.normal(size=(20, 12)), np.repeat(base[:1], 30, axis=0),
                              base[1] + 0.05 * rnd.normal(size=(40, 12))]).astype("float32")
    rows = [(i, [float(x) for x in v], int(i % 2 if i < 60 else 0)) for i, v in enumerate(vectors)]
    odd = [None, [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [], [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, rows[0][1], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(table, block=16, cell_rows=5).collect()}
    usable = {i: (np.array(v, float) / np.linalg.norm(v), l) for i, v, l in rows if i < 1000}
    near = {(a, b) for a, (u, l) in usable.items() for b, (v, m) in usable.items() if a != b and l == m and u @ v >= 0.98}
    root = components(list(usable), lambda a, b: (a, b) in near)
    least: dict[int, int] = {}
    for i, c in root.items():
        least[c] = min(i, least.get(c, i))
    for i, _, _ in rows:
        links, comp = (sum(a == i for a, _ in near), least[root[i]]) if i in usable else (0, i)
        assert got[i] == (links, comp, comp == i)
    assert neighbours.near_vectors(table.limit(0)).count() == 0


def test_neighbours_of_very_large_and_small_components(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0), (3, [2.0, 2.0], 0), (4, [1e-200, -1e-200], 0)]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_toxicity_on_held_out_rows(spark, empty):
    rnd = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing"]) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words[rnd.randrange(60)] = rnd.choice(["vilewort", "grubspit", "scumling"])
        rows.append((i, " ".join(words), None, None, None, None, None, None))
        marks.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, *[None] * 6), (901, "", *[None] * 6), (None, "vilewort grubspit", *[None] * 6)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert len({r.score for r in toxicity.score_toxicity(table, labels.limit(0)).collect()}) == 1


def test_language_on_held_out_rows(spark, empty):
    rnd = random.Random(4)
    stems = {"aa": "tion ment able er ing the".split(), "bb": "keit ung schaft der zu ein".split()}
    rows = [(i, " ".join(rnd.choice(stems[lang]) + rnd.choice(stems[lang]) for _ in range(40)), lang, *[None] * 5)
            for i in range(300) for lang in [rnd.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", *[None] * 5), (901, "123 ?!", "aa", *[None] * 5), (902, "", None, *[None] * 5)]
    got = {r.doc_id: r for r in langid.identify_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902))
    assert langid.identify_language(empty).count() == 0


def test_html_blocks_and_cut(spark):
    page = ("<html><head><title>T</title><script>var t='</p>'</script></head><body class='menu-open'><nav><a href=/a>A</a></nav>"
            "<div class='ad'>Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>One  &#39;sentence&#39;.<br>More."
            "<p>Ok.</p><section class='comments'><p>I disagree with all of this text.</p></section></article>"
            "<form><p>Sign up</p></form><footer>&copy; site</footer></body></html>")
    assert html.extract(page) == "Head & line\nOne 'sentence'. More.\nOk."
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    plain = "<body>" + "".join(f"<p>{entities.escape(sentence(30))}.</p>" for _ in range(4)) + "<ul><li><a href=x>Home</a></ul>"
    assert html.extract(plain).count("\n") == 3
    pages = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 2), (None, None, None, 3)],
                                  "page_id long, url string, html string, text int")
    got = html.extract_pages(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["<![ endif]>", "<![foo[ x ]]>", "<![1]>", "<![endif]-->", "<![if !IE]>", "<![CDATA[ x ]]>", "<!>", "<!x>",
                                 "<svg><![CDATA[ <p>1 > 0 ]]></svg>", "<![endif]"])
def test_html_goes_on_after_a_declaration(odd):
    one, two = sentence(30) + ".", sentence(30) + "."
    got = html.extract(f"<body><article><p>{one}</p>{odd}<p>{two}</p></article>").split("\n")
    assert got[0] == one and got[-1] == two


def test_minimum_cut_is_minimal():
    rnd = random.Random(7)
    for _ in range(40):
        n = rnd.randint(1, 7)
        costs = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def value(keep):
            return (sum(c for c, k in zip(costs, keep) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep) if c < 0 and k)
                    + sum(w for a, b, w in edges if keep[a] != keep[b]))
        best = min(value([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert value(html.max_flow_labels(costs, edges)) == pytest.approx(best, abs=1e-6)


def test_sharding_balances_and_numbers(spark, docs, empty):
    got = sharding.shard_documents(docs, shards=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    many = spark.range(4_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copy of one text', repeat(md5(cast(id AS string)), 1 + id % 5)) AS text")
    sizes = Counter()
    for r in sharding.shard_documents(many, shards=8).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    assert sharding.shard_documents(empty).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path, docs, labels):
    import corpus_pipeline
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        now = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < 4:
                assert now.columns == docs.columns
        assert now.count() >= (0 if frame is not docs else 1)
