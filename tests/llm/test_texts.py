"""Language, SentencePiece, packing and toxicity."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from partloom.llm import langid, packing, pieces, toxicity
from partloom.llm.queries import PIECES, WORD_BPE, tokenizer_path

ODD = [None, "", " \n", "\x1c \x1d", "it's, we'll. I'M!", "áb É ß İ ςΣ", "日本語 テスト", "<|endoftext|> a", "▁ x▁", "a" * 3000, "No. 5²", "😀!"]


def docs_of(spark, texts, more="lang string"):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], f"doc_id long, text string, {more}")


def corpus(seed, n=240):
    rng = random.Random(seed)
    parts = {"aa": ["the", "of", "thin", "er", "ing"], "bb": ["der", "und", "ung", "schei", "für"], "cc": ["ла", "не", "что", "мир"]}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
    return [(i, text(k := rng.choice(sorted(parts))), k) for i in range(n)], text


def test_language(spark):
    rows, text = corpus(1)
    docs = spark.createDataFrame(rows + [(900, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.langs == ["aa", "bb", "cc"] and model.scripts["cyrillic"] == [2]
    mixed = text("aa") + " " + text("aa") + " \n" + text("bb")
    asked = [*ODD, *[r[1] for r in rows], mixed, "мир мир"]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, asked, "score string"), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[11].lang_pred == "und" and got[0].score == 0
    assert got[6].lang_pred in model.langs  # letters of a script that none has
    assert np.mean([got[len(ODD) + i].lang_pred == r[2] for i, r in enumerate(rows)]) > 0.97
    spans = got[len(ODD) + len(rows)].spans
    assert [s.lang for s in spans] == ["aa", "bb"] and sum(s.words for s in spans) == len(langid.words_of(mixed))
    assert got[len(asked) - 1].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.where("false"), model).count() == 0
    empty = langid.learn(docs.where("false"))
    assert langid.identify(docs_of(spark, ["abc"]), empty).first().lang_pred == "und"


def test_many_languages():
    """More languages than a byte counts."""
    rng = np.random.default_rng(8)
    s = np.full((30, 200), -40.0, np.float32)
    s[:15, 170] = s[15:, 199] = 0
    (path,) = langid.viterbi([s + rng.normal(0, 0.1, s.shape).astype(np.float32)])
    assert path.tolist() == [170] * 15 + [199] * 15


def plain_language(model, text):
    """(language, share of letters) by scoring every path of a short text."""
    words = langid.words_of(text)
    k, n = len(model.langs), len(words)
    if not n:
        return "und", 0.0
    score = np.zeros((n, k))
    for i, w in enumerate(words):
        grams = [f"<{w}>"[j : j + 3] for j in range(len(w))]
        score[i] = sum(model.logp[model.grams.get(g, len(model.grams))].astype(float) for g in grams)
        own = model.scripts.get(langid.script_of(w))
        if own is None:
            score[i] = 0
        else:
            floor = score[i][own].min() + langid.WRONG_SCRIPT
            score[i] = [score[i][j] if j in own else floor for j in range(k)]
    best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(score[i][j] for i, j in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
    letters = [sum(len(w) for w, j in zip(words, best) if j == lang) for lang in range(k)]
    return model.langs[int(np.argmax(letters))], max(letters) / sum(letters)


def test_language_of_whole_documents_is_that_of_the_best_path(spark):
    rows, text = corpus(12)
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rng = random.Random(13)
    asked = [" ".join([*text("aa").split()[: rng.randint(0, 4)], *text("bb").split()[: rng.randint(0, 3)], *text("cc").split()[: rng.randint(0, 2)]]) for _ in range(60)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_of(spark, asked), model).collect()}
    for i, t in enumerate(asked):
        lang, score = plain_language(model, t)
        assert got[i] == (lang, pytest.approx(score)), t


def plain_viterbi(s, switch):
    value, back = s[0].astype(float), []
    for row in s[1:]:
        top = int(value.argmax())
        came = [k if value[k] >= value[top] - switch else top for k in range(len(value))]
        back.append(came)
        value = np.array([max(value[k], value[top] - switch) for k in range(len(value))]) + row
    path = [int(value.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_viterbi():
    rng = np.random.default_rng(3)
    scores = [rng.normal(0, 6, (n, 3)).astype(np.float32) for n in (1, 7, 0, 30, 2, 7)]
    for s, path in zip(scores, langid.viterbi(scores, 5.0), strict=True):
        assert path.tolist() == (plain_viterbi(s, 5.0) if len(s) else [])
    for s in [rng.normal(0, 4, (40, 3)) + [[3, 0, 0]] for _ in range(60)]:
        one = langid._constant(s)
        if one is not None:
            assert set(plain_viterbi(s, langid.SWITCH)) == {one}


def test_pieces_round_trip_and_best_path(spark):
    c = pieces.Codec(tokenizer_path(PIECES))
    rows, _ = corpus(2, 30)
    texts = [*ODD[1:], *[r[1] for r in rows], "  two  spaces\n\nand lines ", "\t", "x" * 200 + "\x00"]
    for t in texts:
        assert c.decode(np.frombuffer(c.encode(t), "<u4").tolist()) == t

    def worth(text):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 48), end):
                p = text[start:end]
                s = c.score[p][1] if p in c.score else c.unknown_score(p) if end == start + 1 else float("-inf")
                best[end] = max(best[end], best[start] + s)
        return best[-1]

    name = {i: s for i, s in c.score.values()}
    for t in [r[1][:120] for r in rows]:
        signs = pieces.SPACE + t.replace(" ", pieces.SPACE)
        ids, got, k = c.best(signs), 0.0, 0
        assert np.frombuffer(c.encode(t), "<u4").tolist() == ids
        while k < len(ids):
            if ids[k] in name:
                got, k = got + name[ids[k]], k + 1
            else:
                first = c.bytes_[ids[k]][0]
                n = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                got, k = got + c.unknown_score(b"".join(c.bytes_[i] for i in ids[k : k + n]).decode()), k + n
        assert got == worth(signs)
    path = tokenizer_path(PIECES)
    back = pieces.decode(pieces.encode(docs_of(spark, ODD), path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ODD and back[1].ids == [] and back[0].ids is None
    digest = {r.doc_id: r for r in pieces.digest(docs_of(spark, ODD), path).collect()}
    assert digest[0].round_trip is None and all(r.round_trip for i, r in digest.items() if i)
    assert pieces.digest(docs_of(spark, ODD).where("false"), path).count() == 0


def test_pieces_are_no_more_than_the_models_own(spark):
    import sentencepiece

    path = tokenizer_path(PIECES)
    c, own = pieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows, _ = corpus(6, 40)
    texts = [*[r[1] for r in rows], "the quick brown fox", "Les données, naïves: 12345 ... ==> größer", "日本語 テスト ok"]
    assert c.ranked and all(len(c.encode(t)) // 4 <= len(own.encode(t)) for t in texts)


def test_long_chunks_get_the_same_path(monkeypatch):
    c = pieces.Codec(tokenizer_path(PIECES))
    rng = random.Random(17)
    for t in ["".join(rng.choices("abcdetrß日▁", k=rng.randint(1, 80))) for _ in range(40)]:
        literal = frozenset(k for k, x in enumerate(t) if x == "▁" and rng.random() < 0.5)
        whole = c.best(t, literal)
        monkeypatch.setattr(pieces, "LONG", 0)
        assert c.best(t, literal) == whole
        monkeypatch.undo()


def test_decoding_takes_any_ids():
    c = pieces.Codec(tokenizer_path(PIECES))
    the = next(i for p, (i, _) in c.score.items() if p == "the")
    assert c.decode([the]) == "the" and c.decode([]) == ""
    assert c.decode([None, 10**6, -1, the]) == "\ufffd" * 3 + "the"
    assert c.decode([c.byte_id[0xE9], the]) == "\ufffdthe"


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_BPE)
    rng = random.Random(5)
    texts = [*ODD, *["word " * rng.choice([1, 3, 3, 9, 40, 700]) for _ in range(120)], "und " * 5000]
    docs = docs_of(spark, texts, "rank string")
    rows = packing.pack(docs.unionByName(docs.where("doc_id < 3")), path, capacity=512).collect()
    t = Tokenizer.from_file(path)
    of = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    want = sorted((i, p, p * 512, len(ids[p * 512 : p * 512 + 512]), zlib.crc32(struct.pack(f"<{len(ids[p * 512 : p * 512 + 512])}I", *ids[p * 512 : p * 512 + 512]))) for i, ids in [*of.items(), *[(i, of[i]) for i in range(3)]] for p in range(-(-len(ids) // 512)))
    assert sorted(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(docs.where("false"), path).count() == 0


def least_bins(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([7, 10, 13])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, left = packing.reduce(counts, capacity)
        rest = np.repeat(np.arange(capacity + 1), left).tolist()
        assert sum(n for _, n in fixed) + least_bins(rest, capacity) == least_bins(items, capacity)
        table = packing.plan(counts, capacity)
        assert sum(w * k for w, k in enumerate(counts)) == sum(items) and len(table) <= len(items)


def test_toxicity(spark):
    rng = random.Random(9)
    words, bad = [f"w{i}" for i in range(200)], ["vequus", "vequet", "idiot", "moron"]

    def text(toxic):
        out = rng.choices(words, k=rng.randint(10, 60))
        for _ in range(rng.randint(2, 4) if toxic else 0):
            out.insert(rng.randrange(len(out)), rng.choice(bad))
        return " ".join(out)

    toxic = [int(rng.random() < 0.2) for _ in range(900)]
    docs = spark.createDataFrame([(i, text(t)) for i, t in enumerate(toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"idiot", "vequ*"} <= set(model.lexicon) and not any(w in model.lexicon for w in words)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == toxic[i] for i in held)
    asked = docs_of(spark, [*ODD, "you 1d1ot w5", "w1 w2 id1ot"], "toxic string")
    odd = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert len(odd) == len(ODD) + 2 and all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1] and odd[len(ODD) + 1] > odd[1]
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score(docs.limit(1), none).first().score == pytest.approx(0.5)


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float)
    steps, shares = toxicity.isotonic(x, y)
    assert (np.diff(steps) > 0).all() and (np.diff(shares) >= 0).all() and 0 < shares.min() < shares.max() < 1
    steps, shares = toxicity.isotonic(np.array([0.0] + [1.0] * 10), np.array([0.0] + [1.0] + [0.0] * 9))
    assert (np.diff(shares) >= 0).all()


def plain_isotonic(y, w):
    """Every block's share by the max-min formula."""
    n = len(y)
    mean = lambda a, b: float((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum())
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        y = (rng.random(n) < np.linspace(0.1, 0.9, n)).astype(float)
        steps = toxicity._pool(np.arange(n), y, np.ones(n))
        got = np.concatenate([np.repeat(b[1] / b[2], b[2]) for b in steps])
        assert got == pytest.approx(plain_isotonic(y, np.ones(n)))


def plain_boost(x, y, trees, depth, rate, ridge=1.0):
    """Boosting that tries every split between neighbouring values."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    value = np.full(len(x), np.log(share / (1 - share)))
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + ridge)

    def grow(at, g, h, left, out):
        best, pick = 1e-9, None
        for f in range(x.shape[1]) if left else ():
            for t in np.unique(x[at, f])[:-1]:
                low, high = at[x[at, f] <= t], at[x[at, f] > t]
                gain = worth(g[low], h[low]) + worth(g[high], h[high]) - worth(g[at], h[at])
                if gain > best + 1e-9:
                    best, pick = gain, (low, high)
        if pick is None:
            out[at] = rate * g[at].sum() / (h[at].sum() + ridge)
        else:
            for side in pick:
                grow(side, g, h, left - 1, out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-value))
        out = np.zeros(len(x))
        grow(np.arange(len(x)), y - p, p * (1 - p), depth, out)
        value = value + out
    return value


def test_boosting_takes_the_best_of_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(8):
        x = rng.integers(0, 12, (60, 3)).astype(float) + rng.random(3)
        y = (x[:, 0] + rng.normal(0, 3, 60) > 7).astype(float)
        got = toxicity.boost(x, y, trees=6, depth=2, bins=4000).raw(x)
        assert got == pytest.approx(plain_boost(x, y, 6, 2, 0.2), abs=1e-6)
