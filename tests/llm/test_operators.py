"""Operators against brute force on small tables, and the cases every operator defines: NULLs, empty and long texts, ties,
repeated rows, empty tables and extra columns whose names clash."""

import collections
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftworks.llm import components, decontamination, jaccard_join, license_scans, line_dedup, packing, quality_rules, secret_scans, token_counts, toxicity, url_filters
from siftworks.llm.common import shingle_set
from siftworks.llm.queries import QUERIES
from siftworks.llm.tokens import encoder, public_path
from siftworks.session import cut_lineage

SF = "/root/testdata/sf0.001"
BPE = public_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, score double, words string, n long"
SPACE = " \t\n\x0b\f\r"

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
RUN = "\n".join(" ".join(f"{chr(97 + j)}{i}" for i in range(20)) for j in range(4))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 5), (4, "one two", "en", "a", 7),
    (5, LONG, "en", "a", len(LONG)), (6, RUN, "en", "a", len(RUN)), (7, "new first line\n" + RUN + "\nlast line", "en", "a", 9), (7, "new first line\n" + RUN + "\nlast line", "en", "a", 9),
    (8, RUN, "de", "b", len(RUN)), (9, "a  b\n\nc é你 <|endoftext|> x", "de", None, 3), (None, "text without an id", "en", "b", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 2.0, "w", 3) for r in ODD]
    return cut_lineage(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_ids_are_those_of_the_library(texts):
    enc, whole = encoder(BPE), Tokenizer.from_file(BPE)
    special = ["a  b", " a", "a ", "a\n\nb", "x <|endoftext|> y", "a \t b\r\nc  d", "it's 10,000 don't", "你好 \U0001f600 é", "a\tb  c", "a\nb c\nd"]
    for t in [*texts.values(), *special]:
        got = whole.encode(t, add_special_tokens=False)
        assert enc.ids(t).tolist() == got.ids
        assert len(enc.ends(t)) == len(got.ids) and (not t or enc.ends(t)[-1] == len(t))


def test_packing(spark, odd, empty):
    rows = packing.pack(odd, BPE).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in per.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    whole = Tokenizer.from_file(BPE)
    own = collections.defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    for i, t, *_ in ODD:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = own[i]
        copies = sum(x[0] == i for x in ODD)
        assert sum(r["length"] for r in got) == len(ids) * copies
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["piece"] == 0 or r["length"] == 1024
    assert packing.pack(empty, BPE).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 50, 60), strict=True)}
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, first, n, sequence, offset in packing.plan(counts, 100):
        ranks[length] += range(first, first + n)
        for k in range(n):
            used[sequence + k].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in used.values():
        ends = [0]
        for o, n in sorted(places):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 100
    bound = max(-(-sum(n * c for n, c in counts.items()) // 100), sum(c for n, c in counts.items() if n > 50))
    assert len(used) <= bound * 1.12 + 1
    assert all(sum(3 * n > 100 for _, n in p) <= 2 for p in used.values())


def test_ids_beside_a_null_keep_their_digits(spark, docs):
    big = 2**53 + 1
    notice = license_scans.TEMPLATES["mit"][0]
    own = spark.createDataFrame([(big, notice), (None, notice), (big + 2, notice)], "doc_id long, text string").coalesce(1)
    want = {big, None, big + 2}
    assert {r["doc_id"] for r in packing.pack(own, BPE).collect()} == want
    assert {r["doc_id"] for r in token_counts.count_by_section(own, BPE).collect()} == want
    assert {r["doc_id"] for r in license_scans.scan(own, license_scans.train(docs)).collect()} == want


def test_sequences_are_close_to_the_least_number(spark):
    """No packing needs fewer sequences than its tokens or its pieces over half the capacity ask for."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BPE).select("length", "sequence_id").collect()
    least = max(-(-sum(r["length"] for r in rows) // 1024), sum(r["length"] > 512 for r in rows))
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * least + 1


def test_rows_without_a_key_take_part_in_line_dedup(spark):
    rows = [(None, "first\n" + RUN), (1, "second\n" + RUN), (2, "third\n" + RUN)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: ("first\n" + RUN, 0), 1: ("second", 4), 2: ("third", 4)}


def test_token_counts(odd, empty):
    whole = Tokenizer.from_file(BPE)
    got = collections.Counter()
    for r in token_counts.count_by_section(odd, BPE).collect():
        got[r["doc_id"]] += r["n_tokens"]
    for i, t, *_ in ODD:
        assert got[i] == len(whole.encode(t or "", add_special_tokens=False).ids) * sum(x[0] == i for x in ODD)
    assert token_counts.count_by_section(empty, BPE).collect() == []
    counts, crossing = token_counts.attribute(np.array([3, 6, 10]), np.array([0, 5]), 10)
    assert counts.tolist() == [2, 1] and crossing.tolist() == [1, 0]


def _figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd, empty, docs, texts):
    for frame, own in ((docs, list(texts.items())), (odd, [(x[0], x[1]) for x in ODD])):
        want = collections.Counter((i, *_figures(t)) for i, t in own)
        rows = quality_rules.judge(frame).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).collect() == []


def test_sketch_quartiles(spark):
    values = [float(x) for x in np.random.default_rng(3).lognormal(3, 1, 2000)]
    df = spark.createDataFrame([("a", x) for x in values], "g string, v double")
    sketched = quality_rules.sketch(df, {"v": df["v"]}, ("g",))
    r = quality_rules.quartiles(sketched, ("g",)).first()
    assert r["n"] == 2000
    for q in (25, 75):
        assert abs(r[f"q{q}"] / np.percentile(values, q) - 1) < 0.03


def _brute_lines(rows, min_words=50):
    """Line runs by comparison with all earlier ones."""
    first, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
        words = [len(x.split()) for x in lines]
        gone, own = set(), []
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += words[b]
                if n >= min_words:
                    run = tuple(lines[a : b + 1])
                    if run in first:
                        gone.update(range(a, b + 1))
                    first.add(run)
                    own.append(run)
        out[i] = [x for k, x in enumerate(lines) if k not in gone], len(gone)
    return out


def test_line_dedup(spark, docs, texts, odd, empty):
    shared = [" ".join(f"{c}{k}" for k in range(18)) for c in "abcdefg"]
    rng = np.random.default_rng(5)
    made = {i: "\n".join(shared[int(k)] if rng.random() < 0.8 else f"own {i} {k} {j}" for j, k in enumerate(rng.integers(0, 7, 9))) for i in range(40)}
    made[50] = "\n\n".join(shared[:3] * 5)
    for own in (texts, made):
        frame = spark.createDataFrame(list(own.items()), "doc_id long, text string")
        want = _brute_lines(list(own.items()))
        for r in line_dedup.dedup(frame).collect():
            lines, gone = want[r["doc_id"]]
            assert r["n_removed"] == gone, r["doc_id"]
            assert r["text"] == ("\n".join(lines) if gone else own[r["doc_id"]])
    got = collections.defaultdict(list)
    for r in line_dedup.dedup(odd).collect():
        got[r["doc_id"]].append((r["text"], r["n_removed"], r["words"], r["n"]))
    assert got[1][0][0] is None and got[2][0][0] == "" and got[6][0][1] == 0 and got[8][0][:2] == ("", 4)
    assert got[7] == [("new first line\nlast line", 4, "w", 3)] * 2
    assert line_dedup.dedup(empty).collect() == []


def _weighted(items, item, window):
    total = len(items)
    df = collections.Counter(s for x in items for s in set(x))
    weight = lambda s: np.log1p(total / (df[s] if s in set(item) else 1))
    a, b = collections.Counter(item), collections.Counter(window)
    low = sum(weight(s) * min(a[s], b[s]) for s in a)
    return low / (sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items()) - low)


def _grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)]


def test_decontamination(spark, texts, odd, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"].lower().split() for r in benchmark.collect()}
    own = dict(texts)
    for k, (i, w) in enumerate(list(items.items())[:12]):
        changed = list(w)
        if k % 3 == 1:
            changed[0] = "changed"
        if k % 3 == 2:
            changed[len(w) // 2] = "changed"
        own[10_000 + i] = "before it. " + " ".join(changed) + " after"
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    want = {}
    grams = {i: _grams(w) for i, w in items.items()}
    every = list(grams.values())
    for d, t in own.items():
        words = (t or "").lower().split()
        at = collections.defaultdict(list)
        for k, g in enumerate(_grams(words)):
            at[g].append(k)
        for i, w in items.items():
            starts = {max(0, k - j + e) for j, g in enumerate(grams[i]) for k in at.get(g, ()) for e in range(-2, 3)}
            best = max((_weighted(every, grams[i], _grams(words[s : s + len(w)])) for s in starts), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.contaminated(frame, benchmark).collect()}
    assert got == want and len(want) > 10
    tiny = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (1, "one two")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.contaminated(odd, tiny).collect()} == {4}
    assert decontamination.contaminated(empty, tiny).collect() == [] and decontamination.contaminated(odd, tiny.limit(0)).collect() == []


def test_hamming_blocks_find_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    for flips in (0, 5, decontamination.RADIUS):
        for _ in range(20):
            other = base
            for b in rng.choice(64, flips, replace=False):
                other ^= 1 << int(b)
            parts = [((base >> 8 * i) & 255, (other >> 8 * i) & 255) for i in range(decontamination.BLOCKS)]
            assert any(bin(x ^ y).count("1") <= 1 for x, y in parts)


def test_borderline_windows_are_found(spark):
    """Items whose first words are replaced so that 0.80 to 0.85 of the shingles are shared."""
    rng = np.random.default_rng(12)
    items, docs = [], []
    for i in range(1200):
        n = int(rng.choice([31, 40, 49, 58, *range(31, 60)]))
        k = next(k for k in range(n, 0, -1) if (n - 4 - k) / (n - 4 + k) >= 0.8)
        words = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([f"d{i}x{j}" for j in range(k)] + words[k:])))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got.keys() == {(i, i) for i in range(1200)} and 0.8 - 1e-9 <= min(got.values()) <= max(got.values()) <= 0.85


def _brute_components(own):
    sets = {i: set(shingle_set(t).tolist()) for i, t in own.items()}
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in held[x])
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in own}


@pytest.mark.parametrize("frequent", [64, 3])
def test_jaccard_join(spark, texts, odd, empty, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = np.random.default_rng(8)
    own = dict(texts)
    base = [f"v{k}" for k in rng.integers(0, 10_000, 130)]
    passage = [f"p{k}" for k in range(60)]
    for i in range(150):  # a large group of near copies around one text
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 8)), replace=False):
            w[at] = f"x{rng.integers(0, 40)}"
        own[20_000 + i] = " ".join(w)
    for i in range(60):  # a passage that many texts share
        own[30_000 + i] = " ".join(passage + [f"y{k}" for k in rng.integers(0, 10_000, int(rng.integers(5, 60)))])
    own |= {40_000: "Aa b", 40_001: "aA B", 40_002: None, 40_003: " ", 40_004: "a b c d e f", 40_005: "A B c d e f"}
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == _brute_components(own)
    rows = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect())
    assert rows[8, 6] == 1 and rows[7, 6] == 2 and rows[1, 1] == 1 and rows[None, None] == 1
    assert jaccard_join.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("sizes", [(1, 1), (5, 300), (300, 310), (4_000, 9_000)])
def test_odd_sketches_bound_the_difference(sizes):
    rng = np.random.default_rng(sum(sizes))
    for common in (0, 1, min(sizes) // 2, min(sizes)):
        x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in sizes)
        y[:common] = x[:common]
        diff = len(set(x.tolist()) ^ set(y.tolist()))
        bound = jaccard_join._differing(*(jaccard_join.odd_sketch(np.unique(v)) for v in (x, y)))
        assert bound <= diff and (bound > 0 or diff < 2 or common)
    assert jaccard_join._differing(jaccard_join.odd_sketch(x), jaccard_join.odd_sketch(x)) == 0


@pytest.mark.parametrize("sizes", [(1, 1), (60, 75), (300, 370), (1_000, 560), (4_000, 4_900)])
def test_folded_sketches_bound_the_difference(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    rows, diffs = [], []
    for common in (0, 1, min(sizes) // 2, min(sizes)):
        x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in sizes)
        y[:common] = x[:common]
        folded = [jaccard_join._folded(jaccard_join.odd_sketch(np.unique(v)), len(v), 80) for v in (x, y)]
        rows.append([w.tolist() for w in folded])
        diffs.append(len(set(x.tolist()) ^ set(y.tolist())))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>")
    for columns in (("x", "y"), ("y", "x")):
        got = [r[0] for r in frame.select(jaccard_join._differing_bits(*map(F.col, columns))).collect()]
        assert all(a is not None and a <= b for a, b in zip(got, diffs, strict=True))
        assert 180 * got[0] > 20 * sum(sizes) or sum(sizes) < 10  # sets without a common shingle are told apart


@pytest.mark.parametrize("crowded", [0, 1_000_000])
def test_jaccard_join_in_crowded_lists(spark, crowded, monkeypatch):
    """Texts that share most of their words without being near copies, chains among them, with and without sketches in the join."""
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    monkeypatch.setattr(jaccard_join, "WORTH_A_ROUND", 0.0)
    rng = np.random.default_rng(11)
    passage, own = [f"p{k}" for k in range(120)], {}
    for i in range(120):  # some pairs reach the threshold, most do not
        own[i] = " ".join(passage + [f"y{k}" for k in rng.integers(0, 10_000, int(rng.integers(8, 40)))])
    for i in range(80):  # a chain: each text replaces three more words of the one before
        own[1_000 + i] = " ".join([f"z{k}" for k in range(3 * i)][-90:] + [f"c{k}" for k in range(3 * i, 150)])
    for i in range(60):  # near copies of near copies, none close to all others
        w = [f"g{k}" for k in range(200)]
        for at in rng.choice(200, 6, replace=False):
            w[at] = f"h{i}"
        own[2_000 + i] = " ".join(w)
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == _brute_components(own)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101)], "a long, b long")
    label = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert {label[i] for i in range(61)} == {0} and {label[i] for i in (100, 101, 102)} == {100}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_what_the_distance_allows():
    whole, stems = ["idiot", "scum", "disgusting", "moron"], ["lowei"]
    automaton = toxicity.LexiconAutomaton(whole, stems)
    rng = np.random.default_rng(4)
    for _ in range(3000):
        word = list(str(rng.choice(whole)))
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(0, len(word) + 1))
            what = int(rng.integers(0, 3))
            word[k : k + (what > 0)] = [str(rng.choice(list("abdiostuz")))] if what < 2 else []
        word = "".join(word)
        best = min((_distance(word, t), t) for t in whole if _distance(word, t) <= (len(t) >= 5) + (len(t) >= 10)) if any(_distance(word, t) <= (len(t) >= 5) + (len(t) >= 10) for t in whole) else None
        assert automaton.match(word) == ((best[1], best[0]) if best else None), word
    assert automaton.match("loweischaft") == ("lowei", 0) and automaton.match("lowi") is None


def test_misspelt_stems_are_found():
    automaton = toxicity.LexiconAutomaton(["idiot"], ["worthless", "disgustingly"])
    assert automaton.match("worthles") == ("worthless", 1) and automaton.match("wrothless") is None
    assert automaton.match("worthlessness") == ("worthless", 0) and automaton.match("worhtless") is None
    assert automaton.match("worthlesness") == ("worthless", 1) and automaton.match("disgusstinglly") == ("disgustingly", 2)
    assert automaton.match("idiiot") == ("idiot", 1) and automaton.match("worth") is None


def test_apostrophes_are_no_quotation_marks():
    model = toxicity.ToxicityModel(["idiot", "moron"], [], weights=[-2.0, 3.0, 1.5, 0.3, 0.1])
    plain = model.features("you are an idiot and a moron")
    for t in ("they don't know that you are an idiot and a moron", "l'homme, you are an idiot and a moron", "the dogs' owner is an idiot and a moron", "it's 'em and you're an idiot and a moron", "\"unclosed . and then . you are here and you are such an idiot and a moron today"):
        assert model.features(t)[0] == plain[0] and model.features(t)[2] == 0.0, t
    for t in ("they don't use 'idiot' or ‘moron’ here", "it was “an idiot, a moron” there", "„idiot“ und »moron«", "don't read \"you idiot. you moron\" now"):
        assert model.features(t)[0] == 0.0 and model.features(t)[2] == plain[0], t


def test_toxicity(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.train(large, labels)
    rows = toxicity.score(large.join(labels, "doc_id").filter("pmod(crc32(cast(doc_id as string)), 4) = 2"), model).select("doc_id", "toxic", "predicted", "score").collect()
    wrong = sum(r["predicted"] and not r["toxic"] for r in rows) / sum(not r["toxic"] for r in rows)
    # these six hold no word that is more frequent in toxic than in clean training rows: nothing says what they are
    missed = {r["doc_id"] for r in rows if r["toxic"] and not r["predicted"]}
    assert missed <= {383, 2514, 3351, 8743, 8847, 9062} and wrong < 0.01 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(w >= 0 for w in model.weights[1:])
    for words in (20, 300):  # a misspelt insult never counts less than a calm text of the same length
        calm = " ".join(f"w{i}" for i in range(words))
        assert model.score("you are an idiiot and a mooron " + calm) >= model.score("we are at home and at peace " + calm)
    plain, misspelt = model.score("you are an idiot and a moron they are"), model.score("you are an idiiot and a mooron they are")
    said = model.score('he said "idiot" and she wrote "moron" to them')
    assert plain > 0.3 and plain > misspelt > model.score("a calm text") and plain > said
    out = toxicity.score(odd, model)
    assert out.count() == len(ODD) and out.filter("predicted is null").count() == 0 and "d" in out.columns
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.train(empty, labels).score("idiot") < 0.3


def test_license_scans(docs, odd, empty):
    model = license_scans.train(docs)
    for family, notices in license_scans.TEMPLATES.items():
        for t in notices:
            assert model.judge(t)[0] == family
    assert model.judge("Released under the MIT License, see below.")[0] == "mit"
    assert model.judge("the of and to in is") is None and model.judge("") is None
    rows = license_scans.scan(docs, model).collect()
    cue = {(r["doc_id"], i) for r in docs.collect() for i, p in enumerate((r["text"] or "").split("\n")) if re.search("(?i)licen[sc]e|rights reserved", p)}
    assert {(r["doc_id"], r["paragraph"]) for r in rows if r["confirmed"]} == cue
    assert license_scans.scan(odd, model).collect() == [] and license_scans.scan(empty, license_scans.train(empty)).collect() == []


def test_license_sample_is_of_different_lines(spark):
    lines = [f"{chr(65 + i % 26)}line {i} of the corpus" for i in range(6000)]
    hot = spark.range(40_000).selectExpr("id as doc_id", "'Aone line that every page of a site repeats' as text")
    own = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, 6000, 10)], "doc_id long, text string")
    got = license_scans.sample(own.unionByName(hot))
    every = spark.createDataFrame([(x,) for x in [*lines, "Aone line that every page of a site repeats"]], "p string")
    assert got == [r["p"] for r in every.selectExpr("p", "xxhash64(p) h").orderBy("h", "p").limit(license_scans.MAX_ROWS).collect()]
    assert len({x[0] for x in got}) == 26 and len(license_scans.sample(hot)) == 1


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_license_notices_that_are_wrapped(docs, mark):
    model = license_scans.train(docs)
    for family, notices in license_scans.TEMPLATES.items():
        for t in notices:
            for lead in ([], ["One line of prose goes before this notice", ""], ["int main of the programme stands here without a blank line."]):
                wrapped = textwrap.wrap(t, 72 - len(mark))
                text = "\n".join([*lead, *(mark + x for x in wrapped), mark.rstrip(), "Some words after it."])
                rows = [r for r in model.paragraphs(text) if r[4] >= license_scans.CONFIRM]
                assert [(r[0], r[1], r[2]) for r in rows] == [(len(lead), len(wrapped), family)], (t, lead)
    twice = "\n".join(textwrap.wrap(license_scans.TEMPLATES["mit"][1], 72) * 2)
    assert [r[:3] for r in model.paragraphs(twice)] == [(0, 3, "mit"), (3, 3, "mit")]


def test_secret_scans(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secret_scans.scan(docs).collect()
    found = {(r["doc_id"], r["word_index"]) for r in rows if r["is_secret"]}
    want = set()
    for d in docs.collect():
        words = d["text"].split() if d["text"] else []
        for i, w in enumerate(words):
            if re.search(r"AKIA[0-9A-Z]{16}|^password=[0-9a-f]{8,}|^\"[0-9a-f]{40}\"", w):
                want.add((d["doc_id"], i))
    assert found == want
    assert secret_scans.scan(empty).collect() == []
    assert all(r["score"] == 0.5 or r["label"] is not None for r in secret_scans.scan(odd).collect())


def test_words_beside_a_secret_name_are_candidates(spark):
    from pyspark.sql import functions as F

    own = spark.createDataFrame([(1, "the password: hunter2x9 then", "a"), (2, "secret = Tr0ub4dor&3", "a"), (3, "api_key: correct-horse-battery", "a"), (4, "PASSWORD=a&b", "a"), (5, "no name stands beside short7words", "a")], "doc_id long, text string, source string")
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").withColumn("doc_id", F.col("doc_id") + 1000)
    copies = spark.range(25_000).selectExpr("id + 100000 as doc_id", "'mail to someone@example.com now' as text", "'b' as source")
    rows = [r for r in secret_scans.scan(own.unionByName(real)).collect() if r["doc_id"] < 1000]
    got = {(r["doc_id"], r["value"]): r for r in rows}
    assert {(1, "hunter2x9"), (2, "Tr0ub4dor&3"), (3, "correct-horse-battery"), (4, "a&b")} <= got.keys() and not any(d == 5 for d, _ in got)
    assert got[1, "hunter2x9"]["is_secret"] and got[2, "Tr0ub4dor&3"]["is_secret"] and not any(r["is_secret"] for r in rows if r["value"] in ("the", "then", "password"))
    scores = {r["doc_id"]: r["score"] for r in secret_scans.scan(own.unionByName(copies)).filter("doc_id < 1000 and value in ('hunter2x9', 'Tr0ub4dor&3')").collect()}
    assert len(scores) == 2 and all(0.5 <= x <= 1.0 for x in scores.values())


def test_url_filters(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [("bad.com", day(5), True), ("bad.com", day(10), False), ("bad.com", day(20), True), ("x.org/p", day(1), True), ("tie.net", day(3), True), ("tie.net", day(3), False), (None, day(1), True)]
    captures = [(1, "http://a.BAD.com/x", day(4)), (2, "http://a.bad.com:80/x", day(5)), (3, "http://bad.com", day(10)), (4, "https://u@bad.com/?q", day(25)), (5, "http://x.org/p/q", day(2)), (6, "http://x.org/pq", day(2)), (7, None, day(2)), (8, "not a url", day(2)), (9, "http://tie.net/", day(9)), (9, "http://tie.net/", day(9)), (10, "http://bad.com", None)]
    e = spark.createDataFrame(entries, "pattern string, dated string, listed boolean").withColumn("dated", F_date("dated"))
    c = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F_date("fetched"))
    rows = url_filters.judge(c, e).collect()
    assert {r["page_id"] for r in rows if r["blocked"]} == {2, 4, 5} and len(rows) == 10
    assert url_filters.judge(c.limit(0), e).collect() == [] and not any(r["blocked"] for r in url_filters.judge(c, e.limit(0)).collect())


def test_url_filters_of_long_paths(spark):
    e = spark.createDataFrame([("x.org/a/b/c", "2024-01-01", True), ("x.org/a/b/c/d", "2024-01-01", True)], "pattern string, dated string, listed boolean").withColumn("dated", F_date("dated"))
    c = spark.createDataFrame([(1, "http://x.org/a/b/c/d?q", "2024-01-02"), (2, "http://x.org/a/b/c/e/f", "2024-01-02"), (3, "http://x.org/a/b", "2024-01-02")], "page_id long, url string, fetched string").withColumn("fetched", F_date("fetched"))
    assert {r["page_id"]: (r["n_matches"], r["pattern"]) for r in url_filters.judge(c, e).collect()} == {1: (2, "x.org/a/b/c/d"), 2: (1, "x.org/a/b/c"), 3: (0, None)}


def F_date(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("date")


def test_pipeline(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    step, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        step = cut_lineage(stage(spark, step, SF))
        frames.append(step)
    for before, after in zip([docs, *frames], frames[:-1], strict=False):
        assert after.columns == docs.columns and {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    cut = _brute_lines([(r["doc_id"], r["text"]) for r in frames[0].collect()])
    assert {r["doc_id"]: r["text"] for r in frames[1].collect() if cut[r["doc_id"]][1]} == {i: "\n".join(x) for i, (x, gone) in cut.items() if gone and x}
    near = _brute_components({r["doc_id"]: r["text"] for r in frames[1].collect()})
    assert {r["doc_id"] for r in frames[2].collect()} == {i for i, (_, c) in near.items() if i == c}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contaminated(frames[3], benchmark).isEmpty()
    assert {r["doc_id"] for r in frames[4].collect()} == {r["doc_id"] for r in frames[3].collect()}


def test_stages_keep_odd_rows_and_clashing_columns(spark, odd, empty):
    """Every stage on NULL, empty and long texts, repeated rows, a NULL key and columns named like the stages' own."""
    extra = {"score": 42.0, "predicted": 7, "n_lines": -7, "n_removed": -3, "component_id": 5, "d": 1}
    from pyspark.sql import functions as F

    rows = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(v).alias(k) for k, v in extra.items()])
    kept = [(1, 2, 3, 4, 5, 6, 7, 7, 8, 9, None), (1, 2, 3, 4, 5, 6, 7, 7, 9, None)]
    step = rows
    for (name, stage), ids in zip(corpus_pipeline.STAGES, [kept[0], kept[1], None, None], strict=False):
        after = cut_lineage(stage(spark, step, SF))
        assert after.columns == rows.columns, name
        found = after.collect()
        assert all(r[k] == v for r in found for k, v in extra.items()), name
        if ids:
            assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found) == sorted((i is not None, i or 0) for i in ids), name
        assert {r["doc_id"] for r in found} >= {1, 2, 3, 4, 5, 6, 9, None}, name
        step = after
        assert stage(spark, rows.limit(0), SF).collect() == [], name
    packed = corpus_pipeline.STAGES[-1][1](spark, step, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in step.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), SF).collect() == []


def test_queries_are_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES if n != "pipeline"} == {str(i) for i in range(1, 14)} and "pipeline" in QUERIES
