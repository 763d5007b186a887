"""Whitening, byte-level BPE and ranked lexical search against brute force and the libraries."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siftworks.llm import bpe_codec, lexical_search, whitening
from siftworks.llm.queries import QUERIES
from siftworks.llm.tokens import public_path, public_pattern
from siftworks.session import cut_lineage

SF = "/root/testdata/sf0.001"
RANKS = public_path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, LONG), (6, "a\t \t b\r\nc  d é你\U0001f600 it's 10,000"), (6, "a\t \t b\r\nc  d é你\U0001f600 it's 10,000"),
    (7, "x" * 40_000), (2**53 + 1, "One, TWO; two"), (None, "text without an id"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "a", 1, "x", 7) for r in TEXTS]
    return cut_lineage(spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, term string, score long").repartition(3))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _vectors(spark, rows, extra=False):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    return frame.repartition(3)


def _brute_whitening(vectors, most=16):
    """Per usable row: (n, deviation, whitened by component up to sign, explained), by an eigendecomposition."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(fit), fit.sum(axis=0)
    a = np.array((fit * n - s) / n, float)
    e, v = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    kept = e > 1e-12 * e[0]
    e, v = e[kept][:most], v[:, kept][:, :most]
    out = []
    for row in x:
        c = np.array(row, object) * n - s
        out.append((n, int((c * c).sum()), np.array(c / n, float) @ v / np.sqrt(e), e / np.trace(a.T @ a / n)))
    return out


@pytest.mark.parametrize("case", ["plain", "constant", "dependent", "steep", "few"])
def test_whitening(spark, case):
    rng = np.random.default_rng(4)
    d, n = 12, 300
    base = rng.normal(size=(n, d)) * np.linspace(1, 4, d)
    if case == "constant":
        base[:, 3] = 2.5
    if case == "dependent":
        base = np.round(base * 64) / 64
        base[:, 5], base[:, 6] = base[:, 1] + base[:, 2], base[:, 1]
    if case == "steep":
        base = base @ np.linalg.qr(rng.normal(size=(d, d)))[0] * 10.0 ** np.linspace(-1, 3.5, d)
    if case == "few":
        base = base[:5]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies of one vector fit once
    want = {i: w for (i, _), w in zip(rows, _brute_whitening([v for _, v in rows]), strict=True)}
    got = collections.defaultdict(dict)
    for r in whitening.whiten(_vectors(spark, rows)).collect():
        got[r["vec_id"]][r["component"]] = r
        assert r["identity_error"] < 1e-6
    assert got.keys() == want.keys()
    signs = None
    for i, (n, deviation, whitened, explained) in want.items():
        mine = got[i]
        assert sorted(mine) == list(range(1, len(whitened) + 1))
        assert {(r["n"], r["deviation"]) for r in mine.values()} == {(n, deviation)}
        w = np.array([mine[k]["whitened"] for k in sorted(mine)])
        signs = np.sign(w * whitened) if signs is None else signs
        assert np.allclose(w, whitened * signs, atol=1e-6)
        assert np.allclose([mine[k]["explained"] for k in sorted(mine)], explained, rtol=1e-6)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (None, [1.5, -1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, None]), (7, [-inf, 0.0]), (2**53 + 1, [0.25, 4.0]), (1, [0.5, 1.0])]
    got = whitening.whiten(_vectors(spark, rows)).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 2**53 + 1: 2} and {r["n"] for r in got} == {3}
    assert whitening.whiten(_vectors(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []  # no variance
    with pytest.raises(Exception, match="vectors of 1 and 2 entries"):
        whitening.whiten(_vectors(spark, [(1, [0.5, 1.0]), (2, [0.5])])).collect()


def test_whitening_converges(spark):
    """Each pass squares what is left to the identity: a few suffice for a condition number of 3e5."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 8)) @ np.linalg.qr(rng.normal(size=(8, 8)))[0] * 10.0 ** np.linspace(-1.5, 4, 8)
    model = whitening.fit(whitening.on_grid(_vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(base)])))
    assert model.passes <= 5 and len(model.values) == 8


def test_deviation_beyond_doubles():
    model = whitening.Whitening(3_000_000, np.array([5, 7 * 10**11]), np.ones(1), np.eye(2)[:, :1], 1.0)
    x = np.array([[3, 400_000], [-1_000, 233_333]])
    want = [sum((3_000_000 * int(a) - int(s)) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.deviation(x[:1] * [1, 0] + [[0, 233_300]]).tolist() == [(9_000_000 - 5) ** 2 + (3_000_000 * 233_300 - 7 * 10**11) ** 2]
    with pytest.raises(OverflowError):
        model.deviation(x[:1])
    assert want[0] > 2**63


def test_registered_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = QUERIES["op11_whitening"](spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    want = {r["vec_id"]: w for r, w in zip(rows, _brute_whitening([r["embedding"] for r in rows]), strict=True)}
    per = collections.defaultdict(dict)
    for r in got.collect():
        per[r["vec_id"]][r["component"]] = r
    assert per.keys() == want.keys()
    for i, (n, deviation, whitened, explained) in want.items():
        assert all(r["n"] == n and r["deviation"] == deviation for r in per[i].values())
        assert np.allclose(np.abs([per[i][k]["whitened"] for k in range(1, 17)]), np.abs(whitened), atol=1e-6)
        assert np.allclose([per[i][k]["explained"] for k in range(1, 17)], explained, rtol=1e-4)


def test_bpe_ids_are_those_of_the_library(spark, odd, library):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    parts = ["a", "ab", "th", "e", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "你", "\U0001f600", "\xa0", "՘", "\U0003134b", "\x1c", "the", "ing", "--", "́", "\r\n", " ", "\x85"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x24F), rng.randint(0x370, 0xD7FF), rng.randint(0x10000, 0x3FFFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["ab" * 50_000, "的" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(50_000))]
    own = bpe_codec.codec(RANKS, public_pattern())
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t)


def test_characters_are_classed_as_the_library_does(library):
    """Every character known to Python has the same class in both; the others are asked for one by one."""
    import unicodedata

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    own = bpe_codec.codec(RANKS, public_pattern())
    for before in ("x", "1", "\t"):
        ranks = {bytes([b]): b for b in range(256)}
        for c in chars:
            ranks.setdefault((before + c).encode(), len(ranks))
        whole = tiktoken.Encoding("ask", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in chars if (len(whole.encode_ordinary(before + c)) == 1) != (len(own.pattern.findall(before + c)) == 1)] == []


def _joined(piece, ranks):
    """Joins the adjacent pair of lowest rank again and again."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1 and piece not in ranks:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 62), k) for k in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(6))
def test_backtracking_gives_the_joins_of_small_vocabularies(seed):
    """Vocabularies of few letters, where longest matches often go wrong."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    for _ in range(60):
        a, b = (rng.choice([t for t in ranks if t in (b"a", b"b", b"c") or len(t) > 1]) for _ in range(2))
        if len(a + b) < 9 and a + b not in ranks and _joined(a + b, ranks)[-1:] == [ranks[b]] and len(_joined(a + b, ranks)) == 2:
            ranks[a + b] = len(ranks)
    own = bpe_codec.Codec(ranks, r"[\s\S]+")
    for _ in range(1500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        assert own.merged(piece) == _joined(piece, ranks)


def test_bpe_rows(spark, odd, library):
    ids = bpe_codec.encode(odd, RANKS, public_pattern())
    rows = bpe_codec.decode(ids, RANKS).collect()
    want = collections.Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert bpe_codec.encode(odd.limit(0), RANKS, public_pattern()).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe_codec.decode(null, RANKS).collect()] == [b""]


def test_registered_bpe(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op12_bpe_codec"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r["text"] or "")
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def _terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def _brute_search(docs, items, k):
    words = [(i, collections.Counter(_terms(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total = len(words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(_terms(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c in words:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out |= {(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def _found(frame):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()}


def test_search(spark, odd):
    rng = random.Random(3)
    words = [f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)]
    docs = [(i, " ".join(rng.sample(words, rng.randint(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)]  # equal scores
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(20)] + [(20, " ".join(f"t{k}" for k in range(150))), (21, None), (None, "t1 T2"), (22, "nowhere")]
    items += [(3, "t250 t251")]  # rows of one item are one item
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (50, 3):
        assert _found(lexical_search.search(frame, asked, k)) == _brute_search(docs, items, k)
    tiny = [(1, "One two"), (2, None), (3, ""), (1, "one two"), (4, "ÉÉ é你"), (5, "id w1")]
    small = spark.createDataFrame([(*t, 1) for t in tiny], "item_id long, text string, rank int")
    assert _found(lexical_search.search(odd, small)) == _brute_search(TEXTS, tiny, 50)
    assert lexical_search.search(odd.limit(0), small).collect() == [] and lexical_search.search(odd, small.limit(0)).collect() == []


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)
    monkeypatch.setattr(lexical_search, "BLOCK_COUNTS", 4_000)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert _found(lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), 10)) == _brute_search(docs, items, 10)


def test_masks_group_documents():
    bitmaps = np.random.default_rng(1).random((70, 200)) < 0.05
    different, group = lexical_search.masks(bitmaps)
    assert (different[group] == bitmaps.T).all() and len(different) == len({tuple(c) for c in bitmaps.T.tolist()})


def test_few_documents_are_scored():
    """Masks whose bound is too low are never evaluated."""
    rng = np.random.default_rng(2)
    tf = (rng.random((12, 4000)) < np.linspace(0.6, 0.01, 12)[:, None]).astype(np.int64)
    best = lexical_search.Best(10)
    weights = (1000 * np.linspace(0.5, 5, 12)).astype(np.int64)
    n = lexical_search.search_block(tf, np.full(4000, 100), np.stack([np.ones(4000, np.int64), np.arange(4000)], 1), np.arange(12), weights, best)
    scores = (weights[:, None] * lexical_search.saturation(tf, np.full(4000, 100))).sum(axis=0)
    assert best.scores.tolist() == np.sort(scores)[::-1][:10].tolist() and n < 400
