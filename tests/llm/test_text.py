"""Operators on texts against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from loglathe.llm import bpe, chat, classifier, minhash, mixing, packing, quality, secrets
from loglathe.llm import common as C

from .conftest import SF, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ------------------------------------------------------------------------ 6
def test_bpe_equals_the_library(odd, odd_texts):
    tokenizer = Tokenizer.from_file(PATH)
    got = by_id(bpe.encode_digests(odd, PATH))
    for i, text in enumerate(odd_texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_both_encoders_agree_on_every_token():
    slow, fast = bpe.Encoder(PATH), bpe.encoder(PATH, fast=True)
    words = [t for i, t in enumerate(slow.tokens) if i in slow.halves][::7]
    assert slow.encode_words(words) == [fast.single(w) for w in words]


def test_bpe_lists_and_empty_table(odd, none):
    rows = by_id(bpe.encode_texts(odd, PATH))
    assert rows[0]["ids"] == [] and rows[3]["decoded"] == "word"
    assert bpe.encode_digests(none, PATH).count() == 0


# ------------------------------------------------------------------------ 2
@pytest.mark.parametrize("size", [16, 2048])
def test_packing_places_every_token_once(odd, odd_texts, size):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(odd, PATH, size).toPandas()
    total = 0
    for i, text in enumerate(odd_texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and own.length.max() <= size
        assert (own.length.to_numpy()[1:] == size).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += len(ids) * (2 if i == 6 else 1)
    assert rows.length.sum() == total
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        assert own.length.sum() <= size


def test_plan_is_near_the_lower_bound():
    rng = np.random.RandomState(0)
    h = np.bincount(np.minimum(rng.geometric(1 / 500, 20000), 2048), minlength=2049)
    made = packing.plan(h)
    assert made["sequences"][0] <= 1.01 * math.ceil((h * np.arange(2049)).sum() / 2048)


def test_packing_without_rows(none):
    assert packing.pack(none, PATH).count() == 0


# ------------------------------------------------------------------------ 5
def brute_figures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_figures(odd, odd_texts, spark, none):
    got = by_id(quality.rules(odd))
    for i, text in enumerate(odd_texts):
        n, chars, symbols, dup, repeat = brute_figures(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), i
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.rules(none).count() == 0


def test_figures_of_the_small_table(spark):
    docs = C.table(spark, SF, "documents")
    got = by_id(quality.rules(docs))
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert brute_figures(r["text"]) == (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"])


def test_kneser_ney_sums_to_one():
    texts = ["the cat sat on the mat.", "a cat ate the rat; the rat sat.", "on and on"]
    got, _ = quality.grams(*C.buffers(pa.array(texts)))
    keys, n = np.unique(got, return_counts=True)
    model = quality.kneser_ney(keys, n)
    for context in [0, int(keys[3]) >> 6, int(keys[10]) >> 6, 5 << 12 | 9 << 6 | 33]:
        p = 10 ** quality.log_probability(model, (np.uint32(context << 6) | np.arange(64, dtype=np.uint32)).astype(np.uint32)).astype(float)
        assert abs(p.sum() - 1) < 1e-4


def test_kneser_ney_prefers_its_language():
    en, _ = quality.grams(*C.buffers(pa.array(["the weather and the other brother gathered there with this"] * 5)))
    keys, n = np.unique(en, return_counts=True)
    model = quality.kneser_ney(keys, n)
    mean = lambda t: quality.log_probability(model, quality.grams(*C.buffers(pa.array([t])))[0]).mean()
    assert mean("the brother gathered there") > mean("zq$$ xkcd ##vvw qqj")


def test_each_band_rejects(spark):
    rng = random.Random(5)
    words = lambda letters, size, n: " ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(n))
    texts = {lang: [prose(rng, 200) for _ in range(n)] + [words("aeioulnrst", 7, 80), words("0123456789", 12, 80)] for lang, n in (("en", 60), ("xx", 20), (None, 5))}
    rows = [(100 * k + i, t, lang) for k, (lang, own) in enumerate(texts.items()) for i, t in enumerate(own)]
    got = by_id(quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not any(r["base_failed"] for r in got.values()) and all(r["lower"] < r["upper"] for r in got.values())
    for k, own in enumerate(texts.values()):
        high, low = got[100 * k + len(own) - 2], got[100 * k + len(own) - 1]
        assert high["perplexity"] > high["upper"] and low["perplexity"] < low["lower"] and not high["kept"] and not low["kept"]
        assert sum(got[100 * k + i]["kept"] for i in range(len(own) - 2)) >= 0.9 * (len(own) - 2)


def test_bands_reject_labelled_junk_and_keep_clean_text(spark):
    docs, labels = C.table(spark, "/root/testdata/sf0.01", "documents"), C.table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.rules(docs).join(labels, "doc_id").toPandas()  # labels are used for nothing else
    got = got[~got.base_failed]
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.5


# ------------------------------------------------------------------------ 8
def test_classifier_finds_the_labels(spark, odd, none):
    docs, labels = C.table(spark, "/root/testdata/sf0.01", "documents"), C.table(spark, "/root/testdata/sf0.01", "labels")
    got = classifier.classify(docs).join(labels, "doc_id").toPandas()  # labels are used for nothing else
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.2
    rows = by_id(classifier.classify(odd))
    assert not rows[0]["kept"] and not rows[1]["kept"] and rows[6]["score"] == rows[7]["score"]
    assert classifier.classify(none).count() == 0


def test_em_recovers_labellers():
    rng = np.random.RandomState(1)
    k = len(classifier.LABELLERS)
    truth = rng.rand(20000) < 0.7
    rates = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7])
    right = rng.rand(20000, k) < rates
    votes = np.where(right == truth[:, None], classifier.GOOD, classifier.BAD)
    votes[rng.rand(20000, k) < 0.3] = classifier.NONE
    patterns, inverse, counts = np.unique(votes @ 3 ** np.arange(k), return_inverse=True, return_counts=True)
    fitted, post, prior = classifier.fit_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and np.abs(fitted[:, 1, classifier.GOOD] / fitted[:, 1, 1:].sum(1) - rates).max() < 0.03
    assert ((post[inverse] > 0.5) == truth).mean() > 0.95


# ------------------------------------------------------------------------ 4
def test_secret_spans(odd, odd_texts, none):
    got = by_id(secrets.scan(odd))
    for i, text in enumerate(odd_texts):
        spans = []
        for kind, pattern, group, least in (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
            spans += [(m.start(), secrets.KINDS.index(kind), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[2] == k for s in spans) for k in secrets.KINDS[:3]]
        assert set(joined.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert secrets.scan(none).count() == 0


def test_markov_models_tell_random_from_ordinary(spark):
    rng = np.random.RandomState(4)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    random_string = lambda n=32, some=letters: "".join(rng.choice(some, n))
    plain = "the quick module_handler1 was called from request_dispatcher with parameters of the window controller "
    rows = [(i, f"{plain * 5} token = {random_string()} {plain}") for i in range(60)]
    hidden = [random_string(), random_string(32), random_string(40, letters[:52]), random_string(30, letters[26:]), random_string(40), random_string(40), random_string()]
    rows += [(100 + i, f"{plain} é see {h}, {plain}") for i, h in enumerate(hidden[:4])]
    rows += [(200, f"{plain} request_dispatcher_handler1_parameters {plain}"), (201, f'password="abc123"{hidden[6]} {plain}'), (202, hidden[4]), (203, hidden[5])]
    got = by_id(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, h in enumerate(hidden[:4]):
        start = rows[60 + i][1].index(h)
        assert got[100 + i]["spans"] == f"markov:{start}:{start + len(h)}"
    assert got[200]["spans"] == ""
    # what a base span leaves of a run is scored by itself, and texts next to each other are apart
    start = rows[65][1].index(hidden[6])
    assert got[201]["spans"].split(",")[-1] == f"markov:{start}:{start + 32}"
    assert got[202]["spans"] == got[203]["spans"] == "markov:0:40"


def slow_ratio(values, words, text):
    """The log-likelihood ratio of a run by counting pairs one by one."""
    at = {c: i for i, c in enumerate(secrets.ALPHABET)}
    pairs = lambda strings: collections.Counter(p for s in strings for p in zip(["^", *s], [*s, "^"]))
    logs = []
    for counts, uniform, backing in ((pairs(values), 0.5, 20), (pairs(words), 0, 200)):
        first, second, total = collections.Counter(), collections.Counter(), sum(counts.values())
        for (x, y), n in counts.items():
            first[x] += n
            second[y] += n
        size = len(at) + 2
        p = lambda x, y: (counts[x, y] + backing * ((1 - uniform) * (second[y] + 1) / (total + size) + uniform / size)) / (first[x] + backing)  # noqa: E731, B023
        logs.append(sum(math.log(p(x, y)) for x, y in zip(["^", *text], [*text, "^"])))
    return logs[0] - logs[1]


def test_ratio_equals_a_slow_one(monkeypatch):
    values, words = ["f3ef4d6b2755a36d7d9c25bd", "Zx81kQpLm20s"], ["the", "window", "controller", "request_handler"]
    ratio = secrets.model(secrets.pair_counts([v.encode() for v in values], edges=True), secrets.pair_counts([w.encode() for w in words], edges=True))
    s = secrets.CODE[np.frombuffer(b"Zk3f8window9", np.uint8)]
    ours = ratio[s[:-1], s[1:]].sum() + ratio[secrets.EDGE, s[0]] + ratio[s[-1], secrets.EDGE]
    # strings that share an edge character also count edge pairs between them as one edge each
    assert abs(ours - slow_ratio(values, words, "Zk3f8window9")) < 1e-9


def test_redaction():
    assert secrets.redact("ab SECRET1 cd", "assign:3:10") == "ab [SECRET] cd"
    assert secrets.redact("abcdef", "assign:1:4,hex:2:5") == "a[SECRET]f"
    assert secrets.redact(None, "") is None


# ------------------------------------------------------------------------ 1
def test_base_scores(odd, odd_texts, none):
    rows = mixing.score(odd).collect()
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for i, t in [*enumerate(odd_texts), (6, odd_texts[6])]:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        own = tokens(odd_texts[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert mixing.score(none).count() == 0


def test_rare_tokens_are_joined(odd, monkeypatch):
    before = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in mixing.score(odd).collect()}
    monkeypatch.setattr(mixing, "TOP", 16)
    after = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in mixing.score(odd).collect()}
    assert before == after


def test_bits_are_the_codes():
    weights = np.array([5, 1, 1, 8, 2])
    t = mixing.tree(weights)
    codes = [(t["steps"][a : a + n] & 1).tolist() for a, n in zip(t["first"], t["length"])]
    assert sum(2.0**-n for n in t["length"]) == 1 and len(set(map(tuple, codes))) == 5 and t["length"][3] == 1
    assert [int(c) for c in t["codes"]] == [sum(b << 63 - i for i, b in enumerate(c)) for c in codes]
    zero, one = mixing.shares(t, weights.astype(float))
    for node in range(4):  # the symbols that pass a node by each of its bits
        for bit, got in ((0, zero), (1, one)):
            assert got[node] == sum(w for w, a, n in zip(weights, t["first"], t["length"]) if 2 * node + bit in t["steps"][a : a + n])


def slow_mix(inputs, gates, weights):
    """ln p of one text's bits, one after the other."""
    w, total = [list(x) for x in weights], 0.0
    for first in range(0, len(gates), mixing.TURN):
        rows = range(first, min(first + mixing.TURN, len(gates)))
        seen, steps = collections.Counter(), collections.defaultdict(float)
        for i in rows:
            z = max(-11.5, min(11.5, sum(a * x for a, x in zip(w[gates[i]], inputs[i]))))
            total -= math.log(1 + math.exp(-z))
            seen[gates[i]] += 1
            for k, x in enumerate(inputs[i]):
                steps[gates[i], k] += x / (1 + math.exp(z))
        for (g, k), x in steps.items():
            w[g][k] += mixing.RATE / (mixing.HOLD + mixing.CURVE * seen[g]) * x
    return total


def test_mixing_equals_a_slow_mixer():
    rng = np.random.RandomState(3)
    sizes = [0, 1, 700, 5000, 511, 512, 513, 1300, *rng.randint(1, 300, 12)]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n = len(doc)
    inputs, gate = (rng.standard_normal((n, 3)) + 0.5).astype(np.float32), rng.randint(0, mixing.GATES, n)
    weights = rng.rand(mixing.GATES, 3)
    got, _, _ = mixing.mix({"inputs": np.ascontiguousarray(inputs.T), "gate": gate.astype(np.uint8), "doc": doc}, weights, len(sizes))
    for i in range(len(sizes)):
        own = np.flatnonzero(doc == i)
        assert math.isclose(got[i], slow_mix(inputs[own].tolist(), gate[own].tolist(), weights.tolist()), rel_tol=1e-4, abs_tol=1e-4)


def test_numbers_and_planes():
    rng = np.random.RandomState(5)
    high = rng.randint(0, 1 << 40, 300).astype(np.uint64) << np.uint64(20)
    for values in (np.zeros(0, np.uint64), np.zeros(4, np.uint64), rng.randint(0, 50, 500).astype(np.uint64), np.repeat(high, 3), high[:9].repeat(90) | rng.randint(0, 3, 810).astype(np.uint64)):
        distinct, number = mixing.numbers(values)
        want = np.unique(values, return_inverse=True)
        assert (distinct == want[0]).all() and (number == want[1]).all()
    for values in (high, high.astype(np.uint32), rng.randint(0, 2, 9) > 0, np.zeros((3, 0), np.int16)):
        assert (mixing.opened(mixing.shut(values), values.dtype) == values.reshape(-1)).all()
    logits = np.array([0, 0.5, -3.25, 9.999, 12, -np.inf])
    assert np.abs(mixing.fixed(logits) * mixing.UNIT - logits.clip(-10, 10)).max() <= mixing.UNIT / 2 * 1.01


def test_one_pass_learns_from_all_training_documents(monkeypatch):
    """Each training document once, with the markers' shares of the other half; none that is held out."""
    monkeypatch.setattr(mixing, "PIECE", 20)
    monkeypatch.setattr(mixing, "streams", lambda lex, model, tok, per, training, table, *more: (tok.tolist(), per.tolist(), training.all(), table.tolist()))
    folds, per = np.array([0, 2, 5, 3, 4, 2, 6, 1, 40]) % 7, np.array([3, 2, 1, 30, 4, 9, 5, 1, 6])
    n = int(per.sum())
    shut, none = mixing.shut, mixing.shut(np.zeros(0, np.int64))
    row = {"per": shut(per), "folds": shut(folds), "tok": shut(np.arange(n).astype(np.uint32)), "steps": shut(np.zeros((mixing.PREDICTORS, n), np.uint8)), "states": shut(np.zeros((mixing.PREDICTORS, n), np.uint8)), "flags": none, "hits": none, "odd_text": none, "odd_size": none}
    ends, seen = np.cumsum(per), []
    for use, tok, sizes, training, table in mixing.pieces(row, None, None, learning=True):
        assert training and sizes == per[use].tolist() and tok == [x for d in use for x in range(ends[d] - per[d], ends[d])]
        assert table == [0 if folds[d] >= mixing.SECOND else mixing.MARKERS + 1 for d in use]
        seen += use.tolist()
    assert sorted(seen) == np.flatnonzero(folds != mixing.HELD_OUT).tolist()
    scored = [d for use, *_ in mixing.pieces(row, None, None) for d in use.tolist()]
    assert sorted(scored) == list(range(len(per)))


@pytest.mark.parametrize("split", [1 << 20, 2])
def test_context_counts_equal_brute_force(spark, odd, odd_texts, monkeypatch, split):
    """What predicts each token, from counts over all other training documents, whatever the blocks, buckets and parts."""
    monkeypatch.setattr(mixing, "SPLIT", split)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    docs = odd.repartition(3).selectExpr("doc_id", "text", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7, 0) as fold")
    counted = mixing.count_tokens(docs.where("fold <> 2")).toPandas()
    words, letters = counted[counted.kind == 0], np.zeros(256, np.int64)
    own = mixing.lexicon(words.key.to_numpy().astype(np.int64).view(np.uint64), words.c.to_numpy(), int(words.c.sum()), letters)
    lex = spark.sparkContext.broadcast(own)
    made = C.stored(mixing.blocks(docs, lex, 100, C.new_path(spark, "texts")), "blocks")
    for n in (1, 5):
        solved = mixing.answers(mixing.entries(made, lex, n).repartition(n, "bucket").sortWithinPartitions("bucket", "block"))
        rows = mixing.ready(made, solved, lex, n, made.count()).collect()
        texts = []
        for row in rows:
            kept = mixing.read_block(row["file"], "ids", "per", "tok", "folds")
            per, tok, folds = mixing.opened(kept["per"], np.int64), mixing.opened(kept["tok"], np.uint32), mixing.opened(kept["folds"], np.int64)
            steps = mixing.opened(row["steps"], np.uint8).reshape(mixing.PREDICTORS, -1)
            ends = np.cumsum(per)
            texts += [(tok[z - m : z].tolist(), bool(f != 2), steps[:, z - m : z], i) for z, m, f, i in zip(ends, per, folds, kept["ids"])]
        assert sorted(x[3] for x in texts) == sorted([*range(len(odd_texts)), 6])
        follow = collections.defaultdict(collections.Counter)
        mine = [collections.defaultdict(collections.Counter) for _ in texts]
        for d, (tok, teach, _, _) in enumerate(texts):
            for order in mixing.ORDERS:
                for i, t in enumerate(tok):
                    context = (order, *([None] * order + tok[:i])[-order:])
                    mine[d][context][t] += 1
                    follow[context][t] += teach
        walk = lambda t: t if t < mixing.UNKNOWN else 0
        for d, (tok, teach, steps, _) in enumerate(texts):
            for i, t in enumerate(tok):
                for order in mixing.ORDERS:
                    context = (order, *([None] * order + tok[:i])[-order:])
                    whole = sorted(((c, x) for x, c in follow[context].items() if c), key=lambda x: (-x[0], x[1]))[:2]
                    left = [(c - (mine[d][context][x] if teach else 0), x) for c, x in whole]
                    best = max(left, key=lambda x: x[0], default=(0, 0))
                    if best[0] <= 0:
                        assert steps[mixing.ORDERS.index(order), i] == 255
                    else:
                        code = lambda x: own["words"]["steps"][own["words"]["first"][walk(x)] :][: own["words"]["length"][walk(x)]].tolist()
                        a, b = code(t), code(best[1])
                        assert steps[mixing.ORDERS.index(order), i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


def test_scores_beat_the_base_and_tell_copies(spark):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.score(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > 0.9 * held.base_score.sum()
    copies = got.text.map(got.text[~got.held_out].value_counts()).fillna(0) - ~got.held_out
    large = got.n_tokens > 50
    assert got[large & (copies > 0)].bits_per_byte.mean() < 0.5 * got[large & (copies == 0)].bits_per_byte.mean()


# ----------------------------------------------------------------------- 10
def brute_links(texts, least=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    n = len(sets)
    near = [[a != b and bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    return near, sets


def test_jaccard_join(odd, odd_texts, none, monkeypatch):
    texts = [*odd_texts, odd_texts[6]]
    ids = [*range(len(odd_texts)), 6]
    near, sets = brute_links(texts)
    expected = sorted((ids[i], sum(row)) for i, row in enumerate(near))
    for rows in (2048, 2):  # also with components cut into blocks
        monkeypatch.setattr(minhash.graph.cut, "__defaults__", (rows, 2_000_000))
        got = minhash.neighbours(odd).collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got) == expected
        by = {r["doc_id"]: r for r in got}
        assert by[7]["class_id"] == 6 and by[7]["component_id"] == 6 and not by[7]["kept"] and by[8]["component_id"] == 6
        assert by[0]["kept"] and by[0]["n_links"] == 0
    assert minhash.neighbours(none).count() == 0


def test_jaccard_join_over_the_small_table(spark):
    docs = C.table(spark, SF, "documents").toPandas()
    near, _ = brute_links(docs.text.tolist())
    got = {r["doc_id"]: r["n_links"] for r in minhash.op10_jaccard_join(spark, SF).collect()}
    assert got == {int(i): sum(row) for i, row in zip(docs.doc_id, near)}


# ------------------------------------------------------------------------ 7
def test_chats(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": '{"x": "no"}', "after": "a"}]})
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, "assistant", "sure"), (1, 4, "assistant", "sure"), (1, 5, "user", ""),
        (2, 0, "assistant", call), (2, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 3}})), (2, 2, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})), (2, 3, "assistant", None),
        (3, 0, "assistant", json.dumps({"tool_calls": [{"id": "p", "name": "add", "arguments": {}, "after": "q"}, {"id": "q", "name": "add", "arguments": {}, "after": "p"}]})),
        (None, 0, "user", "nobody"), (None, None, None, None),
    ]
    schemas = chat.SCHEMAS | {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "number"}, "y": {"type": "number"}}}}
    got = {(r["conv_id"], r["turn"], r["part"]): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status[1, 1, 0] == status[1, 3, 0] == "linked" and status[1, 5, 0] == "unanswered" and status[1, 0, 0] == "message"
    assert [got[1, t, 0]["depth"] for t in (1, 3, 5)] == [0, 1, 2]
    assert got[1, 1, 0]["valid"] and got[1, 5, 0]["errors"] == "$.text: length"
    assert status[2, 0, 0] == "linked" and got[2, 0, 0]["valid"] and status[2, 0, 1] == "unanswered" and got[2, 0, 1]["depth"] == 1
    assert got[2, 0, 1]["errors"] == "$.y: missing; $.x: not number"
    assert got[2, 0, 0]["line"] == '{"call":{"arguments":{"x":1,"y":2},"id":"a","name":"add"},"content":"{\\"z\\":3}","conversation":2,"depth":0,"role":"assistant","status":"linked","turn":0}'
    assert status[2, 2, 0] == "orphan" and status[3, 0, 0] == status[3, 0, 1] == "cyclic"
    assert status[None, 0, 0] == "unanswered" and len(got) == 12
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth int")).count() == 0


def test_every_distinct_message_has_a_line(spark):
    tool = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    calls = lambda i, x: json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": {"text": x}}]})
    rows = [
        (1, 0, "assistant", calls("a", "one")), (1, 1, "tool", tool("a", "first")), (1, 1, "tool", tool("a", "second")), (1, 1, "tool", tool("a", "second")), (1, 2, "tool", tool("a", "third")),
        (1, 3, "assistant", calls("a", "two")), (1, 4, "tool", tool("zz", "x")), (1, 4, "tool", tool("zz", "y")), (2, 1, "user", "p"), (2, 1, "user", "q"), (2, 2, "assistant", "r"),
        *((None, None, "user", f"lost {i}") for i in range(40)), *((None, 5, "system", f"note {i}") for i in range(40)), *((3, None, "assistant", f"said {i}") for i in range(40)), (None, None, "user", "lost 1"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    lines = [json.loads(r["line"]) for r in got]
    assert len({r["line"] for r in got}) == len(got) == 128
    seen = sorted((x.get("call", {}).get("id"), x["status"], x.get("content") or x["call"]["arguments"]["text"]) for x in lines if x["conversation"] in (1, 2))
    assert seen == [("a", "linked", "first"), ("a", "repeated", "second"), ("a", "repeated", "third"), ("a", "repeated", "two"), ("turn-1", "linked", "r"), ("turn-1", "repeated", "q"), ("zz", "orphan", "x"), ("zz", "repeated", "y")]
    assert all(r["depth"] is None for r in got if r["status"] == "repeated")
    texts = {x.get("content") for x in lines if x["conversation"] not in (1, 2)}
    assert texts == {f"{w} {i}" for w in ("lost", "note", "said") for i in range(40)}


def test_odd_messages_are_lines_and_several_parents_are_ordered(spark):
    calls = lambda *own: json.dumps({"tool_calls": list(own)})
    one = lambda i, after=None, name="reply", args=None: {"id": i, "name": name, "arguments": args if args is not None else {"text": "x"}, "after": after}
    deep = '{"tool_calls":' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [
        (1, 0, "assistant", calls(one("a"), one("b"), one("c", ["a", "b"]), one("d", ["c"]), one("e", ["d", "a"]), one("f", "e"))),
        (2, 0, "assistant", calls(one("a", ["b", "x"]), one("b", ["a", "c"]), one("c"), one("d", ["b", "c"]))),
        (3, 0, "assistant", calls(one(5, 7, name=["no", "name"]), one(7, name={"x": 1}), one("z", args='{"text": NaN}'))),
        (3, 1, "tool", '{"tool_call_id": 7, "content": "\\ud800 half"}'), (3, 2, "assistant", deep), (3, 3, "tool", '{"tool_call_id": "q", "content": Infinity}'),
        (3, 4, "assistant", '{"tool_calls": []}'), (3, 5, "assistant", '{"tool_calls": [{"name": "no id"}]}'), (3, 6, "system", '{"tool_call_id": 1e999}'),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    depth = {(r["conv_id"], r["call_id"]): r["depth"] for r in got}
    assert [depth[1, x] for x in "abcdef"] == [0, 0, 1, 2, 3, 4]
    assert [depth[2, x] for x in "abcd"] == [None, None, 0, None]
    by = {(r["turn"], r["part"]): r for r in got if r["conv_id"] == 3}
    assert by[0, 0]["depth"] == 1 and by[0, 0]["errors"] == "$: no such tool" and by[0, 2]["errors"] == "$: not JSON"
    assert json.loads(by[0, 1]["line"])["content"] == "\ufffd half" and by[0, 1]["status"] == "linked"
    assert len(by) == 8 and json.loads(by[2, 0]["line"])["content"] == deep and by[3, 0]["status"] == "message"
    for r in got:
        assert json.loads(r["line"], parse_constant=lambda x: 1 / 0)


def test_every_message_is_formatted_once(spark):
    messages = C.table(spark, SF, "conversations")
    lines = chat.op7_chat_formatting(spark, SF).toPandas()
    plain = messages.toPandas()
    results = sum(1 for r in plain.itertuples() if r.role == "assistant" and ((plain.conv_id == r.conv_id) & (plain.turn == r.turn - 1) & (plain.role == "user")).any())
    assert len(lines) == len(plain) - results
    assert all(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x for x in lines.line)


def test_initial_weights_come_from_all_training_documents(spark, odd, monkeypatch):
    """Each bit of each training document, once, with the markers' shares of the other half; none held out."""
    seen, train = [], mixing.train_mixer

    def noted(made, lex, model, half):
        sums, bends = train(made, lex, model, half)
        seen.append((half, made, lex, model.value, bends))
        bits = np.zeros(3)
        for row in made.select(*mixing.FOUND).collect():
            block = row.asDict() | mixing.read_block(row["file"], *mixing.NEEDED, "ids")
            folds = mixing.opened(block["folds"], np.int64)
            of = (folds != mixing.HELD_OUT) & ((folds > 3) == half)
            for use, found, _ in mixing.pieces(block, lex.value, model.value):
                bits += [np.isin(s["doc"], np.flatnonzero(of[use])).sum() for s in found]
        got = [b.sum() / b.shape[1] / mixing.CURVE for b in mixing.apart(bends)]
        assert bits.all() and np.allclose(got, bits)
        return sums, bends

    monkeypatch.setattr(mixing, "train_mixer", noted)
    assert mixing.score(odd).count() == odd.count()
    assert [x[0] for x in seen] == [0, 1]
    assert not np.array_equal(seen[0][3]["markers"], seen[1][3]["markers"])


def test_top_tokens_are_found_by_their_upper_bits():
    r = np.random.default_rng(5)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64) + np.uint64(7 << 50), np.array([0, 2**64 - 1], np.uint64)]))
    lex = mixing.lexicon(keys, np.arange(len(keys)) + 1, int(len(keys) * (len(keys) + 1) // 2), np.zeros(256, np.int64))
    assert len(lex["index"]) == (1 << 20) + 1
    asked = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), r.integers(0, 1 << 63, 3000).astype(np.uint64)])
    found, at = mixing.look_up(lex, asked)
    assert np.array_equal(found, np.isin(asked, keys)) and np.array_equal(lex["keys"][at[found]], asked[found])


def test_texts_of_about_the_same_length_are_scored_together(monkeypatch):
    """Each text once, the shorter ones first; training keeps the order of the block and takes one half."""
    per = np.array([50, 3, 40, 1, 3, 90, 2, 41])
    folds = np.array([0, 1, 2, 3, 4, 5, 6, 0])
    n = int(per.sum())
    kinds = {"per": per, "folds": folds, "tok": np.full(n, mixing.STOP, np.uint32), "steps": np.full(mixing.PREDICTORS * n, 255, np.uint8), "states": np.zeros(mixing.PREDICTORS * n, np.uint8), "flags": np.zeros(0, np.uint8), "hits": np.zeros(0, bool), "odd_text": np.zeros(0, np.uint8), "odd_size": np.zeros(0, np.int64)}
    row = {k: mixing.shut(x) for k, x in kinds.items()}
    monkeypatch.setattr(mixing, "streams", lambda lex, model, tok, per, *rest: (per.tolist(), None))
    monkeypatch.setattr(mixing, "PIECE", 60)
    got = [(use.tolist(), sizes) for use, sizes, _ in mixing.pieces(row, {}, {})]
    assert [x for use, _ in got for x in use] == [3, 6, 1, 4, 2, 7, 0, 5] and [x for _, sizes in got for x in sizes] == sorted(per.tolist())
    assert [use.tolist() for use, *_ in mixing.pieces(row, {}, {}, 0)] == [[0, 1], [3], [7]]
