"""Operators that SQL cannot express, against plain Python on small tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidencelake.llm import bitpack, decontaminate, language_id, lm_scoring, mixing, ngram_join, repetition
from evidencelake.llm.common import running_sums, word_hashes
from evidencelake.llm.components import components
from evidencelake.llm.queries import QUERIES, tokenizer_file
from tests.llm.conftest import LONG, MESSY, PHRASE

ROOT = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet").collect()


@pytest.mark.parametrize("fixture", ["messy", "given"])
def test_language_model(spark, messy, fixture):
    root = messy if fixture == "messy" else ROOT
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    rows = texts_of(spark, root)
    good = {r.doc_id for r in spark.read.parquet(f"{root}/labels.parquet").filter("quality = 1 and doc_id is not null").collect()}
    ids = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids) for r in rows]
    models = []
    for side in (True, False):
        pair, before, word = Counter(), Counter(), Counter()
        for doc, s in ids:
            if (doc in good) == side:
                for a, b in zip([49_406, *s], s):
                    pair[a, b] += 1
                    before[a] += 1
                    word[b] += 1
        models.append((pair, before, word, sum(word.values())))
    sizes = [m[3] for m in models]
    matched = sizes[1] / sizes[0] if min(sizes) else 1
    want = []
    for doc, s in ids:
        own = (Counter(zip([49_406, *s], s)), Counter([49_406, *s][: len(s)]), Counter(s))
        loss = []
        for side, scale, (pair, before, word, n) in ((True, 1, models[0]), (False, matched, models[1])):
            p, c, w, n = (pair - own[0], before - own[1], word - own[2], n - len(s)) if (doc in good) == side else (pair, before, word, n)
            k, even = 5 * scale, lambda b: (w[b] + 0.5 * scale) / (n + 0.5 * scale * 49_408)
            loss.append(sum(-math.log2((p[a, b] + k * even(b)) / (c[a] + k)) for a, b in zip([49_406, *s], s)) / len(s) if s else None)
        want.append((doc, len(s), *(None if x is None else round(x, 6) for x in loss)))
    got = [(r.doc_id, r.n_tokens, *(None if x is None else round(x, 6) for x in (r.target_bits, r.background_bits))) for r in QUERIES["op1_lm_difference"](spark, root).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_score_does_not_depend_on_being_a_target(spark):
    """Good documents score alike whether they are among the targets or not, and better than the others."""
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id").distinct()
    half = F.xxhash64("doc_id") % 2 == 0
    means = []
    for used in (good.filter(half), good.filter(~half)):
        scored = lm_scoring.cross_entropy_difference(docs, used, tokenizer_file(), 49_408, opening=49_406, direct=True).filter("n_tokens > 0")
        kind = F.when(F.col("doc_id").isin([r.doc_id for r in used.collect()]), "used").when(F.col("doc_id").isin([r.doc_id for r in good.collect()]), "unused").otherwise("rest")
        means.append({r.kind: r.m for r in scored.groupBy(kind.alias("kind")).agg((F.sum(F.col("score") * F.col("n_tokens")) / F.sum("n_tokens")).alias("m")).collect()})
    for m in means:
        assert abs(m["used"] - m["unused"]) < 0.2 and max(m["used"], m["unused"]) < m["rest"]


def test_one_id_in_many_batches(spark):
    """Texts of one id are spread over batches and are all targets."""
    rows = [(1, f"alpha beta gamma number {i} text") for i in range(40)] + [(None, f"other words {i} here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id = 1").select("doc_id"), tokenizer_file(), 49_408, opening=49_406, direct=True).collect()
    assert len(got) == 80 and max(r.score for r in got if r.doc_id == 1) < 0 < min(r.score for r in got if r.doc_id is None)


def tiling(doc, item, least):
    """Greedy string tiling as it is defined: scan all pairs of places for the longest unmarked match, mark it, again."""
    a, b, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        a[i : i + k] = b[j : j + k] = [True] * k
        total += k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), min_size=3, max_size=15))
def test_tiles(doc, item):
    hashes = word_hashes(decontaminate.folded)
    block = decontaminate.Block([(7, hashes.of(" ".join(item).encode()))], 3)
    found = list(decontaminate.tiled_items([" ".join(doc).encode()], block, hashes, 3, 1e-9))
    assert (found[0][2] if found else 0) == tiling(doc, item, 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("abc"), min_size=2, max_size=25), st.integers(1, 4))
def test_tiles_in_order(doc, item, tile):
    """The very tiles of the definition, one by one, with and without seeds."""
    a, b, want = [False] * len(doc), [False] * len(item), []
    while True:
        best = (tile - 1, 0, 0)
        for i, j in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < tile:
            break
        a[i : i + k] = b[j : j + k] = [True] * k
        want.append((i, j, k))
    own, other = (word_hashes(decontaminate.folded).of(" ".join(x).encode()) for x in (doc, item))
    assert decontaminate.tiles(own, other, tile) == want
    if len(item) >= tile:
        assert decontaminate.tiles(own, other, tile, decontaminate.rolling(own, tile)) == want


@pytest.mark.parametrize("item", ["x " * 1000, ("x " * 40 + "y ") * 24, " ".join(f"w{i}" for i in range(50)) + " x" * 500, "x y z " * 300])
def test_tiles_of_repetitive_texts(item):
    """A million equal words, or equal phrases, against a long item: linear memory, a few seconds."""
    import time
    import tracemalloc

    hashes = word_hashes(decontaminate.folded)
    block = decontaminate.Block([(7, hashes.of(item.encode()))], 5)
    for phrase in ("x ", "x y z ", " ".join(f"w{i}" for i in range(50)) + " "):
        text = (phrase * (1_000_000 // len(phrase.split()))).encode()
        words = hashes.of(text)
        started = time.time()
        decontaminate.tiles(words, block.words[0], 5, decontaminate.rolling(words, 5))
        assert time.time() - started < 10
        words = words[:200_000]
        tracemalloc.start()  # tracing makes it several times slower
        decontaminate.tiles(words, block.words[0], 5, decontaminate.rolling(words, 5))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6


def brute_matches(docs, items, tile=5, coverage=0.5):
    """Every document against every item, by the definition."""
    fold = lambda t: [w for w in (decontaminate.folded(w) for w in (t or "").encode().split()) if w]
    out = []
    for doc, text in docs:
        words = fold(text)
        seeds = {tuple(words[i : i + tile]) for i in range(len(words) - tile + 1)}
        for item_id, item in items:
            own = fold(item)
            if not any(tuple(own[j : j + tile]) in seeds for j in range(len(own) - tile + 1)):
                continue
            n = tiling(words, own, tile)
            if n >= coverage * len(own):
                out.append((doc, item_id, n / len(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fixture", ["messy", "given"])
def test_whole_decontamination(spark, messy, fixture):
    """The whole query against brute force, but for the longest texts, where the definition takes too long."""
    root = messy if fixture == "messy" else ROOT
    docs = [(r.doc_id, r.text) for r in texts_of(spark, root) if len(r.text or "") < 6_000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    short = spark.read.parquet(f"{root}/documents.parquet").filter("text is null or length(text) < 6000")
    got = [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.benchmark_matches(short, spark.read.parquet(f"{root}/benchmark.parquet")).collect()]
    assert sorted(got, key=repr) == brute_matches(docs, items) and got


def test_decontamination(spark, messy):
    docs, bench = spark.read.parquet(f"{messy}/documents.parquet"), spark.read.parquet(f"{messy}/benchmark.parquet")
    words = PHRASE.split()
    moved = " ".join([*words[12:], "unrelated words between", *words[:12]])
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit(moved)}))
    got = sorted((r.doc_id, r.item_id, r.tiles) for r in decontaminate.benchmark_matches(docs.filter("doc_id is not null"), bench).collect())
    # doc 9 repeats the one word of the last item
    assert [g for g in got if g[1] == 0] == [(6, 0, 1), (7, 0, 1), (8, 0, 1), (50, 0, 2)] and [g[0] for g in got if g[1] is None] == [9]
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 5, 8, 10, 11, 12, -7}


def test_decontamination_in_blocks(spark, messy, monkeypatch):
    docs, bench = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 600)
    assert len(list(decontaminate.benchmark_blocks(bench, 5, "item_id", "text"))) > 1
    assert sorted(map(tuple, decontaminate.benchmark_matches(docs, bench).collect())) == whole and whole


def segmentations(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        head = pieces.index.get(word[:k], pieces.unknown if k == 1 else None)
        if head is not None:
            for rest in segmentations(word[k:], pieces):
                yield (head, *rest)


@pytest.mark.parametrize("word", ["▁hello", "▁ж", "▁a", "▁straße漢x"])
def test_forward_algorithm(word):
    pieces = language_id.pieces_of(tokenizer_file("piece_bpe_32k.model"))
    probs = np.random.default_rng(0).random((pieces.unknown + 1, 3))
    cuts = pieces.cuts([word])
    every = list(segmentations(word, pieces))
    want = np.array([sum(np.prod([probs[p, x] for p in s]) for s in every) for x in range(3)])
    assert np.allclose(language_id.forward(cuts, probs)[0], np.log(want))
    counts, out = np.ones((1, 3)), np.zeros_like(probs)
    language_id.expected(cuts, probs, counts, out)
    for x in range(3):
        brute = np.zeros(len(probs))
        for s in every:
            for p in s:
                brute[p] += np.prod([probs[q, x] for q in s]) / want[x]
        assert np.allclose(out[:, x], brute)


def test_forward_does_not_underflow():
    pieces = language_id.pieces_of(tokenizer_file("piece_bpe_32k.model"))
    probs = np.full((pieces.unknown + 1, 2), 1e-9)
    assert np.isfinite(language_id.forward(pieces.cuts(["▁" + "zq" * 3000]), probs)).all()


def test_languages_held_out(spark):
    got = QUERIES["op4_language"](spark, ROOT).join(spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_languages_odd_rows(spark, messy):
    got = QUERIES["op4_language"](spark, messy).collect()
    assert len(got) == len(MESSY)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 10)) and by_id[6].lang_pred in ("en", "de", "fr")


def longest_repeats(w):
    best = [0] * len(w)
    for i, j in itertools.combinations(range(len(w)), 2):
        k = 0
        while j + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=1, max_size=5))
def test_suffix_arrays(texts):
    hashes = [word_hashes().of(" ".join(t).encode()) for t in texts]
    got = repetition.repeat_lengths(np.concatenate(hashes), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    assert got.tolist() == [x for t in texts for x in longest_repeats(t)]


@pytest.mark.parametrize("fixture", ["messy", "given"])
def test_repetition(spark, messy, fixture):
    root = messy if fixture == "messy" else ROOT
    want = []
    for r in texts_of(spark, root):
        text = r.text or ""
        words = WORDS.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        n = len(words)
        want.append((r.doc_id, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n))
    got = QUERIES["op6_repetition"](spark, root).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept is False for r in got if r.base_failed)


def test_repetition_keeps_columns(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    kept = repetition.drop_repetitive(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5}
    marked = repetition.repetition(docs)
    assert marked.filter("kept").select("doc_id").distinct().count() == 1 and "lang" in marked.columns


def classes(rows, width=5):
    """(doc_id, n, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            old, new = up[j], up[i]
            up = [new if u == old else u for u in up]
    least = {}
    for u, (d, _) in zip(up, rows):
        least[u] = min([x for x in (least.get(u), d) if x is not None], default=None)
    return sorted(((d, len(s), least[u]) for u, s, (d, _) in zip(up, sets, rows)), key=repr)


@pytest.mark.parametrize("fixture", ["messy", "given"])
def test_ngram_join(spark, messy, fixture):
    root = messy if fixture == "messy" else ROOT
    rows = [(r.doc_id, r.text) for r in texts_of(spark, root)]
    assert sorted(map(tuple, QUERIES["op7_ngram_join"](spark, root).collect()), key=repr) == classes(rows)


def near_copies():
    """A chain of texts in which only neighbours are alike, near copies around one text, and short ones."""
    base = [f"t{i}" for i in range(40)]
    chain = [" ".join(base[3 * k : 3 * k + 40] + [f"t{i}" for i in range(40, 3 * k + 40)][: 3 * k]) for k in range(8)]
    spokes = [" ".join([f"u{i}" if i != k else "changed" for i in range(60)]) for k in range(0, 60, 3)]
    return list(enumerate([*chain, *spokes, *spokes[:3], "one two", "One  two", "one"]))


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_ngram_join_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similarity_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == classes(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=10), min_size=1, max_size=12), st.booleans())
def test_trie(sets, within):
    paths, sizes = [sorted(s) for s in sets], [len(s) for s in sets]
    first = [i % 2 == 0 for i in range(len(sets))]
    links = set(ngram_join.joined(paths, sizes, first, within, 3, 4))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and (within or first[i] != first[j])]

    def groups(edges):
        up = list(range(len(sets)))
        for a, b in edges:
            old, new = up[a], up[b]
            up = [new if u == old else u for u in up]
        return {frozenset(i for i, u in enumerate(up) if u == v) for v in up}

    assert links <= {*pairs, *((j, i) for i, j in pairs)} and groups(links) == groups(pairs)


def test_one_of_each(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # a null id comes first, and twice the phrase is like the phrase; equal rows leave one; texts without words all stay
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, None, 8, 9, 10, 11, 12, -7], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100} | {200 + i: 100 for i in range(30)} | {299: 299, 300: 299}


def test_token_files(spark, messy):
    from tokenizers import Tokenizer

    tok, want, place = Tokenizer.from_file(tokenizer_file()), [], 0
    for doc, text, *_ in sorted(MESSY, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    assert sorted(map(tuple, QUERIES["op8_token_files"](spark, messy).collect()), key=repr) == sorted(want, key=repr)


def test_random_access(spark, messy, tmp_path):
    path = f"{tmp_path}/tokens"
    bitpack.write_token_files(spark.read.parquet(f"{messy}/documents.parquet"), path, tokenizer_file(), 49_408, 2, direct=True)
    own = bitpack.Encoder(tokenizer_file(), direct=False)
    for doc, text in ((12, MESSY[14][1]), (5, LONG), (2, "")):
        want = [*np.frombuffer(own.of(text.encode()), "<u4").tolist(), 2]
        assert bitpack.read_document(spark, path, doc).tolist() == want
    with pytest.raises(KeyError):
        bitpack.read_document(spark, path, 1234)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, 2**w - 1), max_size=60))), st.data())
def test_bits(case, data):
    width, values = case
    ids = np.array(values, np.uint32)
    payload = bitpack.pack(ids, width)
    assert len(payload) == -(-len(values) * width // 8)
    i = data.draw(st.integers(0, len(values)))
    j = data.draw(st.integers(i, len(values)))
    assert bitpack.unpack(payload, width, i, j).tolist() == values[i:j]


def test_width():
    assert [bitpack.width_of(v) for v in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8], np.uint32), 3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ9é'.,!<|>ßÿ÷×ſİ \n\u0301")), max_size=30))
def test_direct_encoding(text):
    own = bitpack.encoder(tokenizer_file(), True)
    assert np.frombuffer(own.of(text.encode()), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_mix(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    plans = [sorted((r.doc_id, r.size, tuple(r.shards)) for r in mixing.plan_mix(d, shards=6, blocks_per_shard=8).collect()) for d in (docs, docs.repartition(7))]
    assert plans[0] == plans[1]
    taken = Counter({d: len(s) for d, _, s in plans[0]})
    assert max(taken.values()) <= 2 and {s for _, _, x in plans[0] for s in x} == set(range(6))
    other = mixing.plan_mix(docs, shards=3, blocks_per_shard=50).collect()
    assert taken == Counter({r.doc_id: len(r.shards) for r in other})
    by_source = {}
    for r in other:
        got = by_source.setdefault(r.source, [0, r.target, 0])
        got[0] += r.size * len(r.shards)
        got[2] = max(got[2], r.size)
    assert all(abs(words - target) <= most / 2 for words, target, most in by_source.values())
    mixed = mixing.mix(docs, shards=6, blocks_per_shard=8)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +taken


def test_mix_repeated_rows(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix(docs, shards=2).collect())
    want = Counter()
    for r in mixing.plan_mix(docs, shards=2).collect():
        want[r.doc_id, r.size] += len(r.shards)
    assert Counter({(d, len(WORDS.findall(t or ""))): n for (d, t), n in mixed.items()}) == +want


def test_split_quotas(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 0), (2, 25)], "rank long, q long")
    halves = [mixing.split_quotas(quotas, 2, seed).withColumn("seed", F.lit(seed)) for seed in range(60)]
    union = halves[0]
    for df in halves[1:]:
        union = union.unionByName(df)
    counts = {(r.seed, r.shard, r["rank"]): r["count"] for r in union.groupBy("seed", "shard", "rank").count().collect()}
    for seed in range(60):
        assert counts[seed, 0, 0] + counts[seed, 1, 0] == 40 and counts[seed, 0, 2] + counts[seed, 1, 2] == 25 and counts[seed, 0, 0] + counts[seed, 0, 2] == 32
    # the mean of a hypergeometric draw: 32 * 40 / 65
    left = [counts[seed, 0, 0] for seed in range(60)]
    assert abs(np.mean(left) - 32 * 40 / 65) < 1.2 and len(set(left)) > 3
    leaves = mixing.split_quotas(quotas, 5).collect()
    sizes = Counter(r.shard for r in leaves)
    assert sorted(sizes) == list(range(5)) and sum(sizes.values()) == 65 and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r["rank"], r.token) for r in leaves}) == 65


def test_blocks_decide_shards(spark):
    """Every block goes to one shard, a shard gets its exact quotas, and all copies of a block's documents are there; places order them anew."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    sizes = mixing.document_sizes(docs)
    targets = mixing.source_targets(sizes)
    total = sum(r.target for r in targets.collect())
    block = -int(-round(total, 3) // (6 * 8))
    dealt = {(r["rank"], r.block): r.shard for r in mixing.deal_blocks(targets, block, 6, 0).collect()}
    quotas = {r["rank"]: math.ceil(r.target / block) for r in targets.collect()}
    assert sorted(dealt) == sorted((k, b) for k, q in quotas.items() for b in range(q))
    leaves = Counter((r.shard, r["rank"]) for r in mixing.split_quotas(targets.select("rank", F.ceil(F.col("target") / block).cast("long").alias("q")), 6).collect())
    assert Counter((s, k) for (k, _), s in dealt.items()) == leaves
    by_source = {}
    for r in mixing.plan_mix(docs, shards=6, blocks_per_shard=8).collect():
        by_source.setdefault(r.source, []).append(r)
    ranks = {r.source: (r["rank"], r.target, r.source_size) for r in targets.collect()}
    import hashlib

    for source, rows in by_source.items():
        rank, target, words = ranks[source]
        place = 0
        for r in sorted(rows, key=lambda r: (hashlib.md5(f"{r.doc_id}:0".encode()).hexdigest(), r.doc_id)):
            starts = [place + e * words for e in (0, 1) if place + e * words + r.size / 2 < target]
            assert r.shards == [dealt[rank, s // block] for s in starts]
            assert r.places == [hashlib.md5(f"0:{s}:{r.doc_id}:{e}".encode()).hexdigest() for e, s in enumerate(r.shards)]
            place += r.size
    mixed = [r.doc_id for r in mixing.mix(docs, shards=6, blocks_per_shard=8).collect()]
    want = sorted((s, p, r.doc_id) for rows in by_source.values() for r in rows for s, p in zip(r.shards, r.places))
    assert mixed == [d for _, _, d in want]


def test_running_sums(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    got = {r.id: (r.before, r.n) for r in running_sums(df, [F.col("id")], {"before": "v", "n": F.lit(1)}).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == (total, i)
        total += i % 7
