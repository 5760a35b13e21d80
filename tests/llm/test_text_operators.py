"""Edge cases and brute-force checks of the training-data operators on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphweft.llm import chat, decontamination, linededup, lmscore, minhash, mixing, quality, suffixdedup, tokenbin, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def edited(text: str, every: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("x" + str(r.random()) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    return [base, base, edited(base, 60, 2), edited(base, 25, 3), prose(4, 200), None, "", " \n\t", "a b", "a b", "one", prose(5, 30) + "\n" + base[100:400] + "\nend", "line a\nline b\nline c\nline d\n" * 3, "übergröße ñandú " * 40, base.upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(len(texts))], "doc_id long, quality int, toxic int")


def clashing(docs):
    """The table with columns named as ours are."""
    for c in ("_f", "_kept", "spans", "bands", "probability", "gone", "score", "found"):
        docs = docs.withColumn(c, docs["text"])
    return docs


# --- minhash -----------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def expected_components(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def test_near_duplicates(docs, texts):
    got = sorted(tuple(r) for r in minhash.near_duplicates(clashing(docs), shingle=4).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == expected_components(texts, 4)


def test_near_duplicates_in_a_large_group(spark):
    base = prose(9, 100)
    texts = [edited(base, 30 + i % 40, i) for i in range(120)] + [edited(base, 12, i) for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect())
    want = [(i, c) for i, _, c, _ in expected_components(texts, 4)]
    assert got == want


def test_near_duplicates_in_families_of_variants(spark):
    r = random.Random(11)
    texts = []
    for family in range(3):
        words = prose(20 + family, 100).split(" ")
        for k in range(250):
            changed = set(r.sample(range(100), r.randint(1, 5)))
            texts.append(" ".join(f"v{k}x{i}" if i in changed else w for i, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = expected_components(texts, 4)
    assert sorted(tuple(x) for x in minhash.near_duplicates(df, shingle=4).collect()) == want
    assert 3 < len({c for _, _, c, _ in want}) < 600


def test_near_duplicates_of_odd_rows(spark):
    long = prose(2, 50_000)
    rows = [(1, "a b c d e"), (1, "p q r s t u v"), (1, None), (2, "p q r s t u v"), (3, "a b c d e"), (4, long), (5, long + " end"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F_lit("x"))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, shingle=4).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (3, 2, 3), (4, got[3][1], 4), (5, got[4][1], 4)]


def test_near_duplicates_behind_an_unlinked_hub(spark):
    words = prose(9, 123).split(" ")

    def changed(places, tag):
        return " ".join(f"{tag}y{k}" if k in places else w for k, w in enumerate(words))

    # texts of four scattered changes are the hubs, linked with none; the last four make the only group
    r = random.Random(5)
    texts = [changed(r.sample(range(10, 110, 5), 4), i) for i in range(150)]
    texts += [changed([20], "a"), changed([90], "b"), changed([33, 52], "c"), changed([33, 52, 71], "d")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect())
    want = [(i, c) for i, _, c, _ in expected_components(texts, 4)]
    assert got == want and len({c for _, c in want}) > 50


def test_prefix_pairs_hold_every_link(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    sets = [sorted(r.sample(range(40), r.randint(5, 30))) for _ in range(150)]
    sets += [sorted({*s[1:], 40 + r.randrange(9)}) for s in sets]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, hashes array<long>")
    members = df.select(F.col("id").alias("rep"), F.size("hashes").cast("long").alias("n"), F.col("id").alias("component"))
    pairs = minhash._prefix_pairs(members, df, 80)
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}
    assert want and {tuple(p) for p in minhash._confirmed(pairs, df, 80).collect()} == want
    assert pairs.count() < len(sets) * (len(sets) - 1) // 4


def test_near_duplicate_filter(spark, docs, empty):
    kept = minhash.near_duplicate_filter(docs)
    assert kept.columns == docs.columns and 1 not in {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert minhash.near_duplicates(odd).count() == 1 and minhash.near_duplicate_filter(odd).count() == 3


# --- decontamination ------------------------------------------------------------


def expected_hits(text, items, window=10):
    words, hit, having = decontamination.alnum_words(text), set(), []
    for name, item in items:
        own = decontamination.alnum_words(item)
        n = min(window, len(own))
        found = False
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found = True
        if found:
            having.append(str(name))
    having.sort()
    return len(words), len(hit), len(having), hashlib.sha256(",".join(having).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_contamination(spark, docs, texts, block_words):
    items = [(1, " ".join(texts[0].split(" ")[20:50])), (2, texts[4][:200].upper()), (3, "A, b!"), (4, None), (5, "zzz yyy"), (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F_lit(7))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(clashing(docs), bench, block_words=block_words).collect()}
    assert got == {i: expected_hits(t, items) for i, t in enumerate(texts)}


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_contamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontamination.contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontamination.contamination(docs, none).collect()} == {False}
    kept = decontamination.decontaminated(docs, bench)
    assert kept.count() == docs.count() and kept.columns == docs.columns


def expected_near(texts, items, window=10, probes=3, slop=2):
    counts = Counter(w for t in texts for w in decontamination.alnum_words(t))
    out = {i: set() for i in range(len(texts))}
    for name, item in items:
        own = decontamination.alnum_words(item)
        n = min(window, len(own))
        for start in range(len(own) - n + 1) if own else ():
            first, *others = sorted(range(start, start + n), key=lambda k: (counts[own[k]], k))[:probes]
            for i, t in enumerate(texts):
                words = decontamination.alnum_words(t)
                for p in (p for p, w in enumerate(words) if w == own[first]):
                    if all(any(own[k] == words[q] for q in range(max(p - first + k - slop, 0), min(p - first + k + slop + 1, len(words)))) for k in others):
                        out[i].add(str(name))
    return {i: sorted(x) for i, x in out.items()}


def test_proximity(spark):
    texts = ["alpha x beta gamma", "alpha x x x beta", "beta alpha", "alpha beta", None, prose(1, 300), edited(prose(1, 300), 4, 3), "w1 w2 w3 " * 40]
    items = [(1, "alpha beta"), (2, " ".join(prose(1, 300).split(" ")[50:90])), (3, "alpha beta gamma"), (4, "w3 w1"), (5, "w2"), (6, "zz w2 w3")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 2):
        got = {r.doc_id: r.near_items for r in decontamination.contamination(docs, bench, slop=slop).collect()}
        assert got == expected_near(texts, items, slop=slop)
    assert "1" not in got[1] and got[0] == ["1", "3"]


def test_contamination_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(12))
    long = prose(3, 60_000) + " " + item + " " + prose(4, 60_000)
    docs = spark.createDataFrame([(None, item), (None, item), (0, item), (1, item), (1, "other"), (1, item), (None, None), (2, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None)], "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs, bench).collect())
    assert got == [(-1, 0, 0, []), (-1, 12, 12, ["1"]), (-1, 12, 12, ["1"]), (0, 12, 12, ["1"]), (1, 1, 0, []), (1, 12, 12, ["1"]), (1, 12, 12, ["1"]), (2, 120_012, 12, ["1"])]
    assert decontamination.decontaminated(docs, bench).count() == 3


def test_each_item_decides_alone(spark):
    items = [(1, "red fox"), (2, "the answer is forty two"), (3, " ".join(f"q{i}" for i in range(12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "a red fox b red fox c red fox d red fox e red fox f"), (1, "so The answer is forty two, yes"), (2, "x " + " ".join(f"q{i}" for i in range(1, 11))), (3, " ".join(f"q{i}" for i in range(9))), (4, "the answer is forty three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench).collect()) == [0, 3, 4]


# --- suffix dedup -----------------------------------------------------------------


def expected_removal(rows):
    data = sorted((i, (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = {}
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts, empty, monkeypatch):
    r = random.Random(3)
    odd = ["".join(r.choices("ab", k=300)) for _ in range(6)] + ["a" * 500, "ab" * 200, "a" * 49, "a" * 50]
    rows = list(enumerate(texts + odd))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    found = suffixdedup.repeats_removed(df.withColumn("pack", F_lit(1)), with_text=True).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found} == expected_removal(rows)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in found)
    assert suffixdedup.repeats_removed(empty).count() == 0
    twins = spark.createDataFrame([(5, texts[0]), (5, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert [x.n_removed for x in suffixdedup.repeats_removed(twins).collect()] == [0, 0, 0]


def test_suffix_dedup_cuts_long_documents(monkeypatch):
    data = np.frombuffer(prose(8, 4000).encode(), np.uint8)
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1000)
    cut = suffixdedup.Runs(data, np.array([0]), np.array([len(data)]))
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(cut.first, cut.last, strict=True)])
    assert np.array_equal(np.sort(starts), np.arange(len(data) - 49))


# --- quality ---------------------------------------------------------------------


def test_quality_counts(docs, texts, labels, empty):
    got = {r.doc_id: r for r in quality.quality_report(clashing(docs), labels).collect()}
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns


def test_quality_thresholds_bound_the_risk(spark):
    r = random.Random(1)
    rows = [(i, "en", r.random() * (0.05 if i % 4 else 0.9), int(i % 4 > 0)) for i in range(6000)]
    features = spark.createDataFrame([(i, s, x, False) for i, s, x, _ in rows], "doc_id long, stratum string, symbol_ratio double, base_failed boolean")
    for rule in quality.GRIDS:
        if rule != "symbol_ratio":
            features = features.withColumn(rule, F_lit(0.0))
    marks = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    (chosen,) = quality.thresholds(features, marks).collect()
    assert quality.cutoffs(chosen.step)["symbol_ratio"] == 0.1 and chosen.good_lost == 0
    # about ln(delta) / ln(1 - risk) = 59 good rows suffice, fewer certify nothing
    few = features.orderBy("doc_id")
    assert quality.thresholds(few.limit(84), marks).count() == 1 and quality.thresholds(few.limit(72), marks).count() == 0


# --- token output -------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_token_ids_read_back(spark, docs, texts, empty, tokenizer_path, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    ids = [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    folder = str(tmp_path / "ids")
    tokenbin.write_token_ids(clashing(docs), tokenizer_path, folder, shard_bytes=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.read_token_summary(spark, folder).collect()}
    start, want = 0, {}
    for i, x in enumerate(ids):
        want[i] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    assert got == want
    assert tokenbin.read_document(spark, folder, 3) == [ids[3]]
    assert tokenbin.token_output(empty, tokenizer_path).count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert sorted(r.start for r in tokenbin.token_output(odd, tokenizer_path).collect()) == [0, 2, 4]


def test_units_equal_the_tokenizer(tokenizer_path):
    own = tokenbin.UnitEncoder(tokenizer_path)
    odd = ["", " ", "  a", "a  b", "a \n b", "a\n b ", " a b", "don't stop 's 'll x's", "\x1c a \x1f b", "a\u0085 b", "<|endoftext|> x <|endoftext|>y", "　 　a", "a ​ b", "é ñ 漢字 😀 x"]
    plain = own.tokenizer.encode_batch(odd, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(odd)] == [e.ids for e in plain]


# --- language model ----------------------------------------------------------------------


def test_scores(docs, texts, empty):
    got = {r.doc_id: r for r in lmscore.scores(clashing(docs), burn_in=1, samples=1).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert got[i].score < 0 and math.isfinite(got[i].score)
    assert lmscore.scores(empty).count() == 0


def test_spelling_is_a_distribution():
    words = [w.encode() for w in WORDS]
    owner, symbol, place = lmscore.contexts(words)
    counts = np.zeros((lmscore.LEVELS[3], 256), np.int64)
    np.add.at(counts, (place, symbol), 1)
    model = lmscore.Spelling.prior()
    for k in range(3):
        model = lmscore.seat_spelling(counts, model, np.random.default_rng(k))
    assert np.allclose(model.predictive.sum(axis=1), 1, atol=1e-4)
    assert model.log_probability([b"w12"])[0] > model.log_probability([b"qqq"])[0]


def test_seats_follow_their_conditional():
    """Tables of a dish against the enumeration of all seatings of its customers."""
    d, a, c = 0.3, 0.7, 5
    chance = Counter({(1,): 1.0})
    for _ in range(c - 1):
        after = Counter()
        for sizes, p in chance.items():
            after[(*sizes, 1)] += p * a
            for k, n in enumerate(sizes):
                after[(*sizes[:k], n + 1, *sizes[k + 1 :])] += p * (n - d)
        chance = after
    want = Counter()
    for sizes, p in chance.items():
        want[len(sizes)] += p / sum(chance.values())
    got = np.bincount(lmscore.seated(np.full(200_000, c), np.full(200_000, a), d, np.random.default_rng(1)), minlength=c + 1) / 200_000
    assert all(abs(got[t] - want[t]) < 0.005 for t in range(1, c + 1))
    many = lmscore.seated(np.array([0, 1, 2, 1000, 100_000]), np.full(5, 5.0), 0.5, np.random.default_rng(1))
    assert many[0] == 0 and many[1] == 1 and (many[1:] >= 1).all() and many[4] > many[3]


def test_word_probabilities_sum_to_one():
    from types import SimpleNamespace

    r = random.Random(4)
    words = sorted({f"w{i}".encode() for i in range(60)} | {b""})
    wide = 6
    counts = Counter((r.randrange(50), min(r.randrange(12), wide - 1)) for _ in range(4000))
    # every word in every context, unseen ones too; the last ten words are unknown to the training tokens
    keys = np.arange(len(words) * wide)
    n = np.array([counts[divmod(int(k), wide)] for k in keys], "<u4")
    row = SimpleNamespace(range=0, words=lmscore._squeezed(words), n_words=len(words), keys=lmscore._steps(keys), n=lmscore._pressed(n))
    state = lmscore.State(3, (0.4, 0.7), np.full(wide - 1, 90.0), 800.0, 60.0, lmscore.Spelling.prior())
    s = lmscore.seating(row, state, wide)
    again = lmscore.seating(row, state, wide)
    assert (s.tables == again.tables).all() and (s.context_tables == again.context_tables).all()
    own = s.context < wide - 1
    totals = np.bincount(s.context[own], weights=s.context_tables[own], minlength=wide - 1)
    customers = np.bincount(s.context[own], weights=s.n[own], minlength=wide - 1)
    state.after = lmscore.State(4, (0.4, 0.7), totals, s.customers.sum(), s.tables.sum(), state.spelling)
    state.known = s.spelled[s.count > 0].sum()
    s, p, follows = lmscore.predictive(row, state, customers)
    one_unknown = int(np.flatnonzero(s.count == 0)[0])  # all unknown words are one type
    use = (s.count > 0) | (np.arange(len(words)) == one_unknown)
    assert math.isclose(p[use].sum(), 1, rel_tol=1e-9)
    for k in range(wide):
        assert math.isclose(follows[(s.context == k) & use[s.word]].sum(), 1, rel_tol=1e-9)


def test_contexts_tell_texts_apart(spark):
    """Words in an order that was learned are likelier than the same words in another."""
    r = random.Random(8)
    texts = [" ".join(x for k in r.choices(range(20), k=60) for x in (f"a{k}", f"b{k}")) for _ in range(80)]
    split = [" ".join(t.split(" ")[::2] + t.split(" ")[1::2]) for t in texts]
    rows = [*enumerate(texts), *((1000 + i, s) for i, s in enumerate(split))]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    df = spark.createDataFrame([(i, t) for i, t in rows if i < 1000 or i in held], "doc_id long, text string")
    got = {x.doc_id: x.score / x.n_tokens for x in lmscore.scores(df).collect()}
    known = [v for i, v in got.items() if i < 1000 and i in held]
    mixed = [v for i, v in got.items() if i >= 1000]
    assert min(known) > max(mixed)


# --- chat ------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 40, chat.CHUNK])
def test_chat_round_trip(spark, chunk):
    said = ["</s>[INST] ok [/INST]", "\\!<\\s>\\", "", None, "<<SYS>>x<</SYS>>", "plain\nline", "[/INST]</s>" * 3]
    turns = [(c, k, ["user", "assistant", "system", "tool:ROLE>>", None][(c + k) % 5], said[(c * 3 + k) % 7]) for c in range(6) for k in range(1 + c)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("loss", F_lit(1))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_conversations(df, chunk=chunk)).collect()}
    for c in range(6):
        own = [(r or "", t or "") for i, _, r, t in turns if i == c]
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.conversation_digests(chat.formatted_conversations(df.limit(0))).count() == 0


def test_chat_escape():
    for t in ["</s>", "\\", "\\!", "<\\!s>", "<<s>>", "[[INST]INST]", "<<<SYS>>", "[/INST[/INST]]"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_template_compiler():
    r = chat.compile_template("{% if 1 == 2 %}no{% elif a and not b %}{{ 'x' + a|upper }}{% else %}z{% endif %}{% set q = 'k' %}{% generation %}{{ q }}{% endgeneration %}")
    assert r({"a": "y", "b": False}) == [("xY", False), ("k", True)] and r({"a": "", "b": False})[0] == ("z", False)
    assert [n.kind for n in chat.fold_body(chat.parse("a{% if true %}b{% endif %}{{ 'c' + 'd' }}"))] == ["text"]
    for bad in ("{{ a.b }}", "{% if a %}", "{{ f(1) }}", "{% for x in y %}", "{{ 'a }}", "{{ a|open }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ nothing }}")({})


def test_template_loops():
    source = "{% set m = 'z' %}{% for m in messages %}{% if loop_first %}<{% endif %}{{ m['text'] }}{% if not loop_last %}, {% else %}>{% endif %}{% endfor %}{{ m }}"
    r = chat.compile_template(source)
    joined = lambda messages: "".join(t for t, _ in r({"messages": messages}))
    assert joined([{"text": "a"}, {"text": "b"}]) == "<a, b>z" and joined([{"text": "a"}]) == "<a>z" and joined([]) == "z"
    nested = chat.compile_template("{% for x in rows %}{% for y in x['cells'] %}{{ y }}{% generation %}{{ y }}{% endgeneration %}{% endfor %};{% endfor %}")
    assert nested({"rows": [{"cells": "ab"}, {"cells": ""}]}) == [("a", False), ("a", True), ("b", False), ("b", True), (";", False), (";", False)]
    taken = []

    def messages():
        for k in range(3):
            taken.append(k)
            yield {"text": str(k)}

    stream = chat.compile_stream("{% for m in messages %}{{ m['text'] }}{% endfor %}")({"messages": messages()})
    assert next(stream) == ("0", False) and taken == [0, 1]  # one message is looked at ahead, no more
    for bad in ("{% for m of x %}{% endfor %}", "{% for m in x %}", "{{ m[k] }}", "{{ m['a' }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for bad in ("{{ m['b'] }}", "{{ m['a']['b'] }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)({"m": {"a": "x"}})


# --- mixing and lines -----------------------------------------------------------------------------


def expected_probabilities(rows, shares):
    """Raking in plain Python, 400 rounds."""
    kinds = [((s or "", g or "", topic), len((t or "").split())) for t, g, s, topic in rows]
    cells = Counter()
    for k, n in kinds:
        cells[k] += n
    wanted = []
    for at, m in enumerate(("_source", "_lang", "_topic")):
        tokens = Counter()
        for k, n in cells.items():
            tokens[k[at]] += n
        rest = sum(n for v, n in tokens.items() if v not in shares[m])
        left = max(0.0, 1 - sum(shares[m].values()))
        raw = {v: (shares[m].get(v, left * n / rest if rest else 0.0) if n else 0.0) for v, n in tokens.items()}
        wanted.append({v: x / (sum(raw.values()) or 1) for v, x in raw.items()})
    fitted = {k: float(n) for k, n in cells.items()}
    for _ in range(400):
        for at, share in enumerate(wanted):
            now = Counter()
            for k, x in fitted.items():
                now[k[at]] += x
            fitted = {k: x * share[k[at]] / now[k[at]] if now[k[at]] else 0.0 for k, x in fitted.items()}
    factor = {k: fitted[k] / n if n else None for k, n in cells.items()}
    top = max((f for f in factor.values() if f is not None), default=0) or 1
    return [1.0 if factor[k] is None else factor[k] / top for k, _ in kinds]


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_mixing(spark, one_task):
    r = random.Random(2)
    kinds = {"prose": "w ", "table": "w | ", "legal": "licence "}
    rows = []
    for i in range(600):
        topic = r.choice(list(kinds))
        rows.append((i, kinds[topic] * r.randint(0, 30), r.choice(["en", "de", "xx", None]), "s0" if i % 3 else f"s{i % 5}", 0))
    rows += [(600, None, "en", "blank", 0), (601, "", None, "s0", 0)]
    df = spark.createDataFrame(rows, DOCS)
    shares = {"_source": {f"s{k}": 0.2 for k in range(5)}, "_lang": {"en": 0.5, "de": 0.2, "zz": 0.1}, "_topic": {"prose": 0.5, "table": 0.3, "legal": 0.2}}
    got = mixing.mixture_report(df, shares=shares, one_task=one_task, tolerance=1e-9).orderBy("doc_id").collect()
    want = expected_probabilities([(t, g, s, x.topic) for (_, t, g, s, _), x in zip(rows, got, strict=True)], shares)
    assert all(abs(x.probability - p) < 1e-7 for x, p in zip(got, want, strict=True))
    assert [x.n_tokens for x in got] == [len((t or "").split()) for _, t, *_ in rows]
    draws = [int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:8], 16) / 2**32 for i, *_ in rows]
    assert all(x.sampled == (d < p) for x, d, p in zip(got, draws, want, strict=True) if abs(d - p) > 1e-6)


def test_mixing_reports_its_margins(spark, docs):
    cells = spark.createDataFrame([("a", "en", "prose", 60), ("a", "de", "prose", 10), ("b", "en", "prose", 20), ("b", "de", "prose", 10)], "_source string, _lang string, _topic string, tokens long")
    wanted = {m: mixing.targets(cells, m, x) for m, x in {"_source": {"a": 0.5}, "_lang": {"en": 0.3, "de": 0.3}, "_topic": {}}.items()}
    found = {(r.margin, r.value): (r.target, r.reached) for r in mixing.margins(mixing.raked(cells, wanted), wanted).collect()}
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in found.values()) and math.isclose(found["source", "b"][0], 0.5) and math.isclose(found["lang", "en"][0], 0.5)


def test_mixing_edges(spark, docs, empty):
    assert mixing.mixture_report(empty).count() == 0 and mixing.mixture_sample(clashing(docs)).columns == clashing(docs).columns
    assert mixing.mixture_report(docs).count() == docs.count()
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (1, " ", None, None, 0), (None, "", "en", "s", 0)], DOCS)
    assert {(r.probability, r.sampled) for r in mixing.mixture_report(blank).collect()} == {(1.0, True)}
    long = spark.createDataFrame([(1, "w " * 300_000, "en", "src0", 0), (2, "w", "en", "src0", 0), (2, "w", "en", "src0", 0)], DOCS)
    assert sorted((r.doc_id, r.n_tokens) for r in mixing.mixture_report(long).collect()) == [(1, 300_000), (2, 1), (2, 1)]


def test_topic_reads_the_whole_text(spark):
    from pyspark.sql import functions as F

    rows = [(0, "w " * 3000 + "Copyright 2020"), (1, "w " * 3000 + "a | b"), (2, "LICENCE"), (3, None), (4, "w " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in df.orderBy("doc_id").select(mixing.topic_of(F.col("text"))).collect()] == ["legal", "table", "legal", "prose", "prose"]


def test_lines(spark, docs, texts, empty):
    rows = [(0, "a\nb\nc\nd"), (1, "x\n a \n\nb\nc\ny"), (2, "a\nb\nc\nd\nb\nc\nd"), (3, None), (4, "a\nb"), (5, "z\nz\nz\nz\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F_lit(1))
    got = {r.doc_id: r.text for r in linededup.line_filter(df).collect()}
    # document 5 keeps its first window, of which the later ones, overlapping it, cover all but the first line
    assert got == {0: "a\nb\nc\nd", 1: "x\n\ny", 2: "", 3: None, 4: "a\nb", 5: "z"}
    assert linededup.line_report(empty).count() == 0 and linededup.line_report(docs).count() == len(texts)


# --- toxicity -----------------------------------------------------------------------------------------


def test_toxicity(spark, empty):
    bad = ["rotten", "vilegro", "vilegra", "vilegrix"]
    rows, marks = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = prose(i, 60).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).split(" ")
        if toxic:
            for k in range(4):
                words[k * 9] = bad[(i + k) % 4]
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "so Rotten, it is", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(clashing(docs), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert sum(got[i].predicted == int(i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    assert [(s.start, s.end) for s in got[1002].spans] == [(3, 9)]
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_marginals_equal_enumeration():
    from itertools import product

    e, t = np.array([0.5, -1.0, 2.0]), np.array([[0.0, -0.3], [0.4, 0.9]])
    weights = {s: math.exp(sum(e[k] * s[k] for k in range(3)) + sum(t[s[k]][s[k + 1]] for k in range(2))) for s in product((0, 1), repeat=3)}
    want = [sum(w for s, w in weights.items() if s[k]) / sum(weights.values()) for k in range(3)]
    got, short = toxicity.marginals([e, e[:1]], t)
    assert np.allclose(got, want) and math.isclose(short[0], math.exp(0.5) / (1 + math.exp(0.5)))


def test_pair_marginals_equal_enumeration():
    from itertools import product

    t = np.array([[0.0, -0.3], [0.4, 1.9]])
    want = np.zeros((2, 2))
    lists = [np.array([0.5, -1.0, 2.0, -0.2]), np.array([0.5, -1.0]), np.array([3.0]), np.zeros(0)]
    for e in lists:
        weights = {s: math.exp(sum(x * k for x, k in zip(e, s, strict=True)) + sum(t[a][b] for a, b in zip(s, s[1:]))) for s in product((0, 1), repeat=len(e))}
        for s, w in weights.items():
            for a, b in zip(s, s[1:]):
                want[a, b] += w / sum(weights.values())
    got = np.zeros((2, 2))
    toxicity.grouped_marginals(lists, t, got)
    assert np.allclose(got, want)


# --- clashing names ------------------------------------------------------------------------------------


def test_filters_keep_columns_of_any_name(spark, docs, labels):
    """All filters return the columns they were given, unchanged, whatever their names."""
    odd = docs
    for c in ("gone", "_kept", "_f", "_stratum", "_doc", "stratum", "_cutoffs", "_n_lines", "row_key", "items", "component_id", "rep", "_source", "probability", "sampled"):
        odd = odd.withColumn(c, F_lit(f"own {c}"))
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").withColumn("doc_id", F_lit(1))
    kept = {
        "quality": quality.quality_filter(odd, labels.withColumn("stratum", F_lit("x"))),
        "near": minhash.near_duplicate_filter(odd),
        "contaminated": decontamination.decontaminated(odd, bench),
        "mixed": mixing.mixture_sample(odd),
        "lines": linededup.line_filter(odd),
    }
    for name, df in kept.items():
        assert df.columns == odd.columns, name
        for r in df.collect():
            assert all(r[c] == f"own {c}" for c in odd.columns if c not in docs.columns), name


def test_quality_verdicts_where_cutoffs_bind(spark):
    """Two strata with cutoffs that are certified, against the bound worked out in Python."""
    r = random.Random(12)
    rows, marks = [], []
    for i in range(3000):
        good = i % 3 > 0
        words = r.choices(WORDS, k=80)
        for k in range(0 if good else 40):
            words[k] = "###"
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", 0))
        marks.append((i, int(good), 0))
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality.quality_report(df, labels).collect()}
    limit, delta = 0.05, 0.05 / 2
    for lang in ("en", "de"):
        own = [(i, t.count("#") / 80, m[1]) for (i, t, g, *_), m in zip(rows, marks, strict=True) if g == lang]
        cutoff, gain = None, 0
        for rule, c in quality.PATH:
            if rule != "symbol_ratio":
                continue  # these reject none of the rows
            lost = sum(x > c for _, x, q in own if q)
            n = sum(q for *_, q in own)
            if sum(math.comb(n, k) * limit**k * (1 - limit) ** (n - k) for k in range(lost + 1)) > delta:
                break
            value = sum(x > c for _, x, q in own if not q) - 20.0 * lost
            if value > gain:
                cutoff, gain = c, value
        assert cutoff is not None
        assert all(got[i] == (x <= cutoff) for i, x, _ in own) and sum(got[i] for i, x, q in own if q) > 0.9 * n
