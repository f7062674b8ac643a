"""The training-data operators against brute force on a small fixture with every edge case, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.llm import ann, bpe, chat, jaccard, pack, passages, quality, shard, suffixes, toxicity

tokens = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["ka", "tion", "Re", "the", "sh", "élan", "über", "ñu"]) + rng.choice(["ble", "st", "nd", ".", "ou"]) * rng.randint(1, 3) for _ in range(n)]


def make():
    passage = words(80, 1)
    base = words(120, 2)
    near = base[:]
    near[60] = "changed"
    texts = [
        None, "", "   \n\t ", "one two three", "One TWO three", " ".join(base), " ".join(near), " ".join(base), "\n".join(base),
        " ".join(words(40, 3) + passage + words(30, 4)), " ".join(words(20, 5) + passage + words(60, 6)), " ".join(passage * 2),
        " ".join(words(9000, 7)), "a" * 1500, "x" * 400 + "y" * 399, "</s>[INST] ok <|endoftext|>   z", "É" * 300 + "b" * 300,
        "\n".join(["same line here"] * 40), "%%% ### $$$ " * 60,
    ]
    rows = [(10 + k, t, "en" if k % 3 else None, "src0" if k % 2 else None, None) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, " ".join(base), "en", "src0", 1)]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names used inside
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("part", F.lit(1)).withColumn("score", F.lit("x")).withColumn("th", F.lit(2))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_jaccard(docs, empty):
    sets = []
    for i, text, *_ in ROWS:
        w = WORD.findall(lower(text))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    smallest = {r: min((i for k, (i, _) in enumerate(sets) if root[k] == r and i is not None), default=None) for r in set(root)}
    want = Counter((i, len(s), smallest[root[k]] if s else i) for k, (i, s) in enumerate(sets))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == want
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_counts_all_links(spark, monkeypatch, block):
    """Many edited copies of one text: every pair of them that is near counts, not only the pairs with one hub."""
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    monkeypatch.setattr(jaccard, "LINK_CHUNK", 50)
    base, rng = words(120, 2), random.Random(1)
    texts = [base] + [[f"new{k}" if j == (k * 13) % 120 or (j == k * 5 and k % 3 == 0) else w for j, w in enumerate(base)] for k in range(24)] + [words(60, 9), words(60, 9)[:59]]
    sets = [{tuple(w.lower() for w in t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = {i: sum(j != i and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, " ".join(base))]
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {100: want[0]}


def test_jaccard_without_ids(spark):
    """A near copy in a row without doc_id is linked, whatever other rows without one hold."""
    base = words(120, 2)
    near = [*base[:60], "changed", *base[61:]]
    rows = [(5, " ".join(base)), (None, " ".join(near)), (None, " ".join(words(90, 9))), (7, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 86, 0), (0, 116, 5), (5, 116, 5), (7, 0, 7)]


def test_moved_shingles():
    for n in (0, 1, 1000):
        sets = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        assert (jaccard._arrived(jaccard._moved(sets)) == sets >> np.uint64(16)).all()


def test_passages(docs, empty):
    first = {}
    last = 1 << 62
    for i, text, *_ in ROWS:
        w = split(text)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, last), last if i is None else i)
    want = Counter()
    for i, text, *_ in ROWS:
        w = split(text)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (last if i is None else i):
                gone.update(range(k, k + 50))
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in passages.removed_words(docs).collect())
    assert got == want
    assert passages.removed_words(empty).count() == 0
    clashing = docs.withColumns({c: F.lit(7) for c in ("kept", "n_words", "n_removed", "copy", "places", "id", "row")})
    kept = passages.filter_documents(clashing)
    assert kept.columns == clashing.columns and kept.where("kept = 7 AND id = 7").count() == kept.count() > 0
    assert passages.filter_documents(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [passages.SHARD, 2])
def test_automata_locate(docs, spark, monkeypatch, shard):
    """Places come from the automata alone: every occurrence of every phrase, in any text; without them nothing goes."""
    monkeypatch.setattr(passages, "SHARD", shard)
    whole = passages.identified(docs)
    codes = passages.coded(whole)
    phrases = b"".join(r.phrases for r in passages.confirmed_phrases(codes, 3).collect())
    width = 2 * passages.HEAD
    known = {phrases[at : at + width] for at in range(0, len(phrases), width)}
    assert len(known) * width == len(phrases) > 3 * width
    want = set()
    for r in codes.collect():
        for k in range(len(r.code) // 2 - passages.HEAD + 1):
            if bytes(r.code[2 * k : 2 * k + width]) in known:
                want.add((r.id, k))
    got = [(r.id, int(k)) for r in passages.occurrences(whole, 3).collect() for k in passages.places_of(r.places)]
    assert set(got) == want  # repeated rows in different tasks say it twice
    monkeypatch.setattr(passages, "located", lambda codes, phrases: codes.select("id", "th", F.lit(b"").alias("places")).limit(0))
    copies = passages.copies_of(whole)[1].where("id > low").count()
    gone = passages.removals(docs)[0].where("places IS NOT NULL").count()
    assert gone == 0 and copies


def test_shards_of_phrases():
    assert passages.shards([(1, 0, 3), (0, 0, 4), (0, 1, 2), (2, 0, 1)], 6) == [[(0, 0), (0, 1)], [(1, 0), (2, 0)]]
    assert passages.shards([], 6) == []


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffixes(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    for _, t in texts:
        seen.update(t[k : k + 400] for k in range(len(t) - 399))
    want = Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        out = np.cumsum(gone[:-1]) > 0
        runs = int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(t) else 0
        want[(i, len(t), int(out.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~out]))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed_bytes(docs).collect())
    assert got == want
    assert suffixes.removed_bytes(empty).count() == 0


def test_deep_shallow_order():
    rng = np.random.default_rng(0)
    rows = np.unique(rng.integers(0, 2, (300, 64)).astype(np.uint8), axis=0)
    rows[:, :24] = 7
    rows = np.unique(rows, axis=0)
    rows = rows[rng.permutation(len(rows))]
    order, common = suffixes.deep_shallow(rows, np.zeros(len(rows), np.int64), 4)
    want = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())
    assert order.tolist() == want
    assert common.tolist() == [-1] + [int(np.argmax(rows[a] != rows[b])) for a, b in zip(want, want[1:])]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokens.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, *_ in ROWS}
    got = pack.pack_documents(docs, path).collect()
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
    assert Counter((r.doc_id, r.start) for r in got) == Counter((i, s) for i, *_ in ROWS for s in range(0, len(ids[i]), 4096))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert pack.pack_documents(empty, path).count() == 0


def test_fill_window_is_exact():
    assert pack.fill_window(Counter({60: 1, 30: 2, 25: 3, 7: 1}), 100) == Counter({60: 1, 30: 1, 7: 1})
    filled = pack.patterns({5: 7, 3: 9, 1: 2}, 10)
    used = Counter()
    for chosen, times in filled:
        assert sum(k * n for k, n in chosen.items()) <= 10
        for k, n in chosen.items():
            used[k] += n * times
    assert used == Counter({5: 7, 3: 9, 1: 2})


def test_bpe(docs, empty):
    import tiktoken

    path = tokens.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    encoded = bpe.encode(docs, path, tokens.PATTERN)
    got = Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect())
    assert got == Counter((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, path).collect()) == Counter((i, (t or "").encode()) for i, t, *_ in ROWS)
    assert bpe.encode(empty, path, tokens.PATTERN).count() == 0


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.judged(quality.stored(quality.with_base(quality.with_counts(docs)))).collect()}
    for i, text, *_ in ROWS:
        t, w = text or "", split(text)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (not r.base_failed or not r.kept)
    assert quality.filter_documents(empty).count() == 0
    plain = Counter((r.doc_id, r.text) for r in quality.filter_documents(docs).collect())
    clashing = docs.withColumns({c: F.lit(7) for c in ("n_words", "n_lines", "kept", "base_failed", "level", "ratio", "__words", "max_length")})
    out = quality.filter_documents(clashing)
    assert out.columns == clashing.columns
    assert Counter((r.doc_id, r.text) for r in out.where("kept = 7 AND base_failed = 7 AND n_words = 7").collect()) == plain and plain


def test_shards(docs, empty, monkeypatch):
    for group in (shard.RANK_GROUP, 2):
        monkeypatch.setattr(shard, "RANK_GROUP", group)
        clashing = docs.withColumns({c: F.lit(7) for c in ("first", "last", "arc", "shard", "slot", "__n", "n")})
        out = shard.shard_rows(clashing, "doc_id", 4, 16)
        assert Counter(out.columns) == Counter([*clashing.drop("shard", "slot").columns, "shard", "slot", "home_shard"])
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in ROWS)
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert shard.shard_rows(empty, "doc_id", 4).count() == 0


@pytest.mark.parametrize("hot", [0, 300])
def test_bounded_ring_is_replayed(spark, hot):
    """Row by row: every row takes its home while there is room, the others walk clockwise from their arc to the next shard with room."""
    rows = spark.createDataFrame([(i if i >= hot else None, i) for i in range(1000)], "k long, v long")
    got = shard.shard_rows(rows, "k", 5, 8).collect()
    places, owners = shard.ring_nodes(5, 8)
    hashes = {r.v: r.h for r in rows.select("v", F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("\0null")), F.lit("ring")).alias("h")).collect()}
    arc = {v: int(np.searchsorted(np.array(places), h)) % len(places) for v, h in hashes.items()}
    room, held, over = Counter({s: 200 for s in range(5)}), Counter(), []
    for v in sorted(arc, key=arc.get):
        if room[owners[arc[v]]]:
            room[owners[arc[v]]] -= 1
            held[arc[v], owners[arc[v]]] += 1
        else:
            over.append(arc[v])
    for a in over:
        at = a
        while not room[owners[at % len(owners)]]:
            at += 1
        room[owners[at % len(owners)]] -= 1
        held[a, owners[at % len(owners)]] += 1
    assert Counter((arc[r.v], r.shard) for r in got) == held


def test_shard_query(spark):
    """Size, checksum and law of the registered query, on whole tables."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = shard.op10_shard_ring(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 24


def test_ring(spark):
    """A row's home is the first virtual node at or after its place; one shard more takes about its share and moves nothing else."""
    rows = spark.range(20000).withColumn("key", F.col("id"))
    homes = {}
    for n in (24, 25):
        homes[n] = {r.id: r.home_shard for r in shard.shard_rows(rows, "key", n).collect()}
        places, owners = shard.ring_nodes(n, 128)
        hashes = dict(map(tuple, rows.select("id", F.xxhash64(F.col("key").cast("string"), F.lit("ring"))).collect()))
        at = np.searchsorted(np.array(places), np.array([hashes[i] for i in sorted(hashes)]))
        assert [homes[n][i] for i in sorted(hashes)] == [owners[k % len(owners)] for k in at.tolist()]
    moved = [i for i in homes[24] if homes[24][i] != homes[25][i]]
    assert {homes[25][i] for i in moved} == {24}
    assert 0.02 < len(moved) / len(homes[24]) < 0.07


def test_ring_ends(spark):
    """Places beside nodes, and behind the last one."""
    places, _ = shard.ring_nodes(3, 4)
    rows = sorted({-(1 << 63), (1 << 63) - 1, -1, 0, *(p + d for p in places for d in (-1, 0, 1))})
    df = spark.createDataFrame([(r,) for r in rows], "place long")
    got = dict(map(tuple, shard.with_arcs(df, "place", places).select("place", "__arc").collect()))
    assert got == {r: int(np.searchsorted(np.array(places), r)) % len(places) for r in rows}


def test_chat(spark):
    said = "</s>[INST] ok \\b [/INST] <<SYS>>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", None), (2, 0, None, "x"), (3, None, "tool[a]", ""), (3, 1, "user", "q"), (3, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text, t.loss) for t in back[1].turns] == [("user", said, False), ("assistant", said, True)] and back[1].valid
    assert [(t.role, t.text) for t in back[2].turns] == [("", "x"), ("assistant", "")] and not back[2].valid
    assert [(t.role, t.text) for t in back[3].turns] == [("tool[a]", ""), ("user", "q"), ("user", "q")]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def labelled(spark, marks):
    """400 texts; one in five holds a few of the words that ``marks(rng)`` makes."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = words(rng.randint(60, 120), i)
        toxic = i % 5 == 0
        for _ in range(6 * toxic):
            w[rng.randrange(len(w))] = marks(rng)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held_out(d, model):
    """Accuracy at the threshold, and how often a marked text scores above an unmarked one."""
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    pairs = [(got[i] > got[j]) + 0.5 * (got[i] == got[j]) for i in out for j in out if i % 5 == 0 and j % 5]
    return sum((got[i] >= 0.3) == (i % 5 == 0) for i in out) / len(out), sum(pairs) / len(pairs)


def test_toxicity(spark, docs, empty):
    d, lab = labelled(spark, lambda rng: rng.choice(["grobian", "scoundrel", "wretch"]))
    model = toxicity.fit(d, lab)
    assert held_out(d, model)[0] >= 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(d, lab.limit(0)).constant == 0.0
    assert toxicity.fit(d, lab.where("toxic = 1")).constant == 1.0
    assert toxicity.filter_documents(docs, lab).columns == docs.columns
    assert toxicity.score(docs, model).schema["score"].dataType.simpleString() == "double"


def test_toxicity_is_a_distance(spark):
    """No toxic word ever comes twice: only what it shares with others shows, which a list of words can't."""
    tail = lambda rng: "".join(rng.choice("abcdefghij") for _ in range(6))
    d, lab = labelled(spark, lambda rng: rng.choice(["grobia", "scound", "wretch"]) + tail(rng))
    assert held_out(d, toxicity.fit(d, lab))[1] >= 0.85  # a list of words: 0.5


def test_toxicity_codes():
    assert toxicity.words_of("Ab, c\tDÉ 1") == ["ab".encode(), b"c", "dÉ".encode(), b"1"]
    assert toxicity.words_of(None) == [] and len(toxicity.words_of("a" * 130)) == 3
    a, b = toxicity._code(b"loweiab"), toxicity._code(b"loweixyz")
    assert a[:12] == b[:12] and a[12:16] != b[12:16] and len(a) == 4 * 6


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [None] + [1.0] * 7), (1003, [float("nan")] * 8), (1004, []), (1005, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = ann.usable(df, "vec_id", "embedding")
    assert use.count() == 601
    got = defaultdict(list)
    for r in ann.nearest(use, use.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.array([*range(600), 1005])
    full = np.vstack([x, x[:1]])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 600, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        want = set(ids[np.argsort(-cos, kind="stable")[:5]].tolist())
        hits += len(want & {v for v, _ in got[q]})
        total += 5
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(s == ann.cosines(ann.scaled(x[q : q + 1]), ann.scaled(full[ids == v]))[0] for v, s in got[q])
    assert hits >= 0.9 * total
    assert ann.nearest(use.limit(0), use, 5).count() == 0


def test_neighbours_beyond_one_part(spark):
    """20,000 vectors around 300 centres: few of the parts are visited, and recall against brute force stays."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 16))[rng.integers(0, 300, 20000)] + 0.4 * rng.normal(size=(20000, 16))).astype(np.float64)
    x[1], x[2], x[3] = x[0], x[0] * 2.0**-700, x[0] * 2.0**700  # ties, also where squares over- or underflow
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50000, [1.0] * 3), (50001, [2.0] * 3)], "vec_id long, embedding array<double>")
    use = ann.usable(df, "vec_id", "embedding")
    assert use.count() == 20000
    router = ann.Router(x[:6000], 20000, 5)
    assert router.parts >= 50 and router.visits <= router.parts // 3
    got = defaultdict(list)
    for r in ann.nearest(use, use.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [v for v, _ in got[0]][:3] == [1, 2, 3] and len({s for _, s in got[0][:3]}) == 1
    unit = ann._unit(x)
    hits = 0
    for q in range(0, 20000, 50):
        cos = unit @ unit[q]
        cos[q] = -9
        hits += len(set(np.argsort(-cos, kind="stable")[:5].tolist()) & {v for v, _ in got[q]})
    assert len(got) == 400 and hits >= 0.9 * 2000


@pytest.fixture(scope="module")
def mixed_ids(spark):
    """Null and repeated doc_ids, each with several texts."""
    base, passage = words(120, 2), words(80, 1)
    near = [*base[:60], "changed", *base[61:]]
    a, b = words(30, 4) + passage, words(90, 9)
    texts = [
        (1, base), (5, near), (None, near), (5, b), (5, b), (None, base), (3, a), (8, words(30, 5) + passage), (8, passage), (8, words(70, 6)),
        (None, words(40, 7) + passage), (None, words(90, 8)), (None, words(90, 8)), (None, [*words(90, 8)[:-1], "end"]), (9, []), (9, []), (None, []),
    ]
    rows = [(i, " ".join(w) if w else None, "en", f"src{k}", None) for k, (i, w) in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_near_duplicate_filter_row_by_row(mixed_ids):
    """One row of each component, also where doc_ids are null or repeated."""
    rows, df = mixed_ids
    got = jaccard.filter_documents(df).collect()
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (lower(t).split() for _, t, *_ in rows)]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root = [root[i] if r == root[j] else r for r in root]
    kept = {root[int(r.source[3:])] for r in got}
    assert len(kept) == len(got) and kept == set(root)
    for r in got:
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[int(r.source[3:])]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)


def test_substring_filter_row_by_row(mixed_ids):
    """Every row is cut by itself: windows of 50 words that a smaller doc_id holds go."""
    rows, df = mixed_ids
    held = defaultdict(lambda: float("inf"))
    key = lambda i: float(1 << 62) if i is None else i
    cut = [(i, split(t)) for i, t, *_ in rows]
    for i, w in cut:
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])] = min(held[tuple(w[k : k + 50])], key(i))
    want = Counter()
    for (i, text, lang, source, n), (_, w) in zip(rows, cut):
        gone = {p for k in range(len(w) - 49) if held[tuple(w[k : k + 50])] < key(i) for p in range(k, k + 50)}
        if not gone:
            want[(i, text, lang, source, n)] += 1
        elif len(gone) < len(w):
            new = " ".join(x for p, x in enumerate(w) if p not in gone)
            want[(i, new, lang, source, len(new))] += 1
    assert Counter(map(tuple, passages.filter_documents(df).collect())) == want


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table_texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_query(spark, table_texts):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.load_ranks(tokens.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in table_texts.items():
        ids = own.encode_ordinary(t)
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in bpe.op7_bpe_words(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_packing_query(spark, table_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got, by = pack.op3_pack_min_slack(spark, SF).collect(), defaultdict(list)
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in table_texts.items()}
    assert Counter((r.doc_id, r.start) for r in got) == Counter((i, s) for i in ids for s in range(0, len(ids[i]), 4096))
    for r in got:
        own = ids[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(own)
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), [*sorted(pieces)[1:], (sum(n for _, n in pieces), 0)])) and min(pieces)[0] == 0
        assert sum(n for _, n in pieces) <= 4096


def test_suffix_query(spark, table_texts):
    seen, raw = Counter(), {i: t.encode() for i, t in table_texts.items()}
    for t in raw.values():
        seen.update(hash(t[k : k + 400]) for k in range(len(t) - 399))
    want = set()
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        out = np.cumsum(gone[:-1]) > 0
        runs = int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(t) else 0
        want.add((i, len(t), int(out.sum()), runs, sha(np.frombuffer(t, np.uint8)[~out].tobytes())))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.op9_suffix_deep_shallow(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_neighbour_query(spark):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = ann.op8_ann_learned_parts(spark, SF).collect()
    hits = total = 0
    for q in (i for i in rows if i % 50 == 0):
        score = {i: float(ann.cosines(ann.scaled(rows[q][None]), ann.scaled(v[None]))[0]) for i, v in rows.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(score[i] == s for _, i, s in own)
        hits, total = hits + len(set(want) & {i for _, i, _ in own}), total + 5
    assert hits >= 0.9 * total


def test_toxicity_query(spark):
    got = {r.doc_id: r for r in toxicity.op5_toxicity_compression(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())


def test_stages_at_the_edges(spark, docs, empty):
    """Null and repeated ids, empty and null texts, ties, clashing columns and empty tables pass every stage; rows only go or lose words."""
    import corpus_pipeline

    clashing = docs.withColumns({c: F.lit(7) for c in ("n_words", "kept", "places", "id", "root", "fold", "row", "class")})
    before = Counter((r.doc_id, r.text) for r in clashing.collect())
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, clashing, SF), stage(spark, clashing.limit(0), SF)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
            continue
        assert out.columns == clashing.columns
        rows = out.collect()
        assert all(r.kept == 7 and r.root == 7 for r in rows)
        if name != "substring_dedup":
            assert not Counter((r.doc_id, r.text) for r in rows) - before
        else:
            assert not Counter(r.doc_id for r in rows) - Counter(i for i, _ in before.elements())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    names = d.columns
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, quality.stored(stage(spark, d, sf))
        if name != "packing":
            assert d.columns == names and d.count() <= before.count()
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, d.collect()))


def test_quality_fences_follow_their_groups(spark):
    """Fences come from the tails of their own group: no two alike where tails differ, none a constant, small groups lean on larger ones."""
    rng = np.random.default_rng(3)
    rows = []
    for source, mean, n in (("prose", 0.2, 20000), ("code", 60.0, 1500), ("few", 60.0, 20)):
        for symbols in rng.gamma(1.0, mean, n):
            rows.append((len(rows), "en", source, 200, 1000, int(symbols), 10, 0, 0, False))
    rows += [(len(rows), "en", "prose", 200, 1000, 150, 10, 0, 0, False), (len(rows) + 1, "en", "code", 200, 1000, 150, 10, 0, 0, False)]
    kind = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    counted = quality.stored(spark.createDataFrame(rows, kind))
    fences = {r.source: r for r in quality.thresholds(quality.sketches(counted)).collect()}
    assert fences["prose"].max_symbol < fences["few"].max_symbol < 750 < fences["code"].max_symbol
    kept = {r.doc_id: r.kept for r in quality.judged(counted).collect()}
    # the same text passes where such texts are common, and not where they aren't
    assert (kept[len(rows) - 2], kept[len(rows) - 1]) == (False, True) and sum(kept.values()) > 0.999 * len(rows)
    # a doubled group has the same quantiles, and leans less on the others
    twice = {r.source: r for r in quality.thresholds(quality.sketches(counted.unionAll(counted))).collect()}
    assert twice["few"].max_symbol != fences["few"].max_symbol and twice["few"].total == 2 * fences["few"].total
    # sketches merge: parts give what the whole gives
    parts = [quality.sketches(counted.where(f"doc_id % 3 = {k}")) for k in range(3)]
    merged = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in quality.sketches(counted).collect()}
    assert {tuple(r) for r in quality.thresholds(merged).collect()} == {tuple(r) for r in fences.values()}


@pytest.mark.parametrize("limit", [quality.BROADCAST_GROUPS, 0])
def test_quality_joins_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", limit)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumns({"lang": F.nullif("lang", F.lit("fr")), "source": F.nullif("source", F.lit("src0"))})
    judged = quality.judged(quality.stored(quality.with_base(quality.with_counts(docs))))
    assert judged.count() == docs.count() and judged.where("kept IS NULL").count() == 0
    assert judged.select("doc_id", "kept").exceptAll(quality.judged(quality.stored(quality.with_base(quality.with_counts(docs)))).select("doc_id", "kept")).count() == 0


@pytest.mark.parametrize("digest", ["as shipped", "all alike", "apart in the last bits"])
def test_equal_digests_are_compared(monkeypatch, digest):
    """Rows with one digest count as one only if their bytes do, and digests keep all of their 64 bits."""
    rng = np.random.default_rng(7)
    strings = rng.integers(0, 3, (300, 8)).astype(np.uint8)
    strings[::7] = strings[0]
    group = rng.integers(0, 4, 300)
    if digest == "all alike":
        monkeypatch.setattr(suffixes, "_digests", lambda x: np.full(len(x), 5, np.uint64))
    elif digest != "as shipped":
        number = {row: k for k, row in enumerate(dict.fromkeys(map(bytes, strings)))}
        monkeypatch.setattr(suffixes, "_digests", lambda x: np.array([(1 << 63) + number[bytes(r)] for r in x], np.uint64))
    monkeypatch.setattr(suffixes, "COMPARED", 64)
    first, of = suffixes.distinct_rows(strings, group)
    names = [(int(g), bytes(r)) for g, r in zip(group, strings, strict=True)]
    assert [names[first[k]] for k in of] == names and len(first) == len(set(names))
    assert len(suffixes.distinct_rows(strings[:0], group[:0])[0]) == 0


@pytest.mark.parametrize("shallow", [0, 1, 2, 6])
def test_multikey_and_tries(monkeypatch, shallow):
    """Multikey quicksort and blind tries give the order of bytes and the common prefixes, whatever the depth."""
    monkeypatch.setattr(suffixes, "COMPARED", 500)
    rng = np.random.default_rng(shallow)
    base = rng.integers(0, 256, 48).astype(np.uint8)
    strings = np.repeat(base[None], 500, axis=0)
    for row in strings:
        at = rng.integers(0, 48, rng.integers(0, 3))
        row[at] = rng.integers(0, 256, len(at))
    strings[:100] = rng.integers(0, 2, (100, 48))
    group = rng.integers(0, 5, 500)
    first, _ = suffixes.distinct_rows(strings, group)
    strings, group = strings[first], group[first]
    order, common = suffixes.deep_shallow(strings, group, shallow)
    names = [(int(group[i]), bytes(strings[i])) for i in order]
    assert names == sorted(names)
    for k in range(len(order)):
        if k == 0 or names[k][0] != names[k - 1][0]:
            assert common[k] == -1
        else:
            assert common[k] == next(j for j in range(48) if names[k][1][j] != names[k - 1][1][j])


def test_words_that_are_kept(monkeypatch):
    """Ids are the tokenizer's own, whatever words a worker still knows and however few it keeps; special strings are text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    monkeypatch.setattr(pack, "CACHED_WORDS", 40)
    encoder = pack.WordEncoder(path)
    rng = random.Random(3)
    batches = [[rng.choice([None, "", " ".join(words(rng.randint(1, 40), rng.randint(0, 9))), "<|endoftext|> It's  a\ttest! <|startoftext|>", "Don't WON'T 3,5 é'ß\n..."]) for _ in range(30)] for _ in range(6)]
    for texts in batches:
        ids, counts = encoder.encode(pa.array(texts, pa.utf8()))
        want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0] and ids.tolist() == [i for one in want for i in one] and counts.tolist() == list(map(len, want))
    assert len(encoder.words) == len(set(encoder.words.to_pylist())) == len(encoder.sizes) and encoder.sizes.sum() == len(encoder.ids)
    assert 49407 not in own.encode("<|endoftext|>", add_special_tokens=False).ids
