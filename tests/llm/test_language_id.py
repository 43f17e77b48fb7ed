"""Language filters against plain sets, and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import language_id

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while thinking about weather",
    "de": "der schnelle braune fuchs springt über faule hunde während überlegungen",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку думая погоде",
    "zh": "快速的棕色狐狸 跳过 懒狗 天气 很好 我们 去 公园",
}


def plain_grams(text):
    """Letters of three places that lie in one word, with a space around it."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return [f" {w} "[k : k + 3] for w in kept.split() for k in range(len(w))]


def sentences(seed, count):
    rnd = random.Random(seed)
    rows = []
    for k in range(count):
        lang = rnd.choice(list(WORDS))
        words = [rnd.choice(WORDS[lang].split()) for _ in range(rnd.randint(1, 25))]
        rows.append((k, rnd.choice([" ", ", ", " 7 ", "\n"]).join(words).capitalize(), lang, "s", 0))
    return rows


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_grams_are_those_of_each_text(monkeypatch):
    texts = ["", "The end", "a", "...", "Übung 3 mal", "x" * 50, "end"]
    for window in (7, 1 << 19):
        monkeypatch.setattr(language_id, "WINDOW", window)
        counts = Counter()
        same: dict[int, set] = {}
        for keys, owner in language_id.grams(texts):
            counts.update(owner.tolist())
            for key, k in zip(keys.tolist(), owner.tolist()):
                same.setdefault(k, set()).add(key)
        assert counts == Counter({k: len(plain_grams(t)) for k, t in enumerate(texts) if plain_grams(t)})
        assert {k: len(v) for k, v in same.items()} == {
            k: len(set(plain_grams(t))) for k, t in enumerate(texts) if plain_grams(t)
        }
        assert same[6] <= same[1]


def test_filter_answers_for_all_languages():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    language = rng.integers(0, 100, 4000)  # more than a 64-bit number holds
    model = language_id.LanguageFilter.build([str(k) for k in range(100)], keys, language)
    masks = model.masks(keys)
    has = (masks[np.arange(4000), language // 64] >> (language % 64).astype(np.uint64)) & np.uint64(1)
    assert has.all()
    other = model.masks(rng.integers(0, 2**63, 200_000).astype(np.uint64))
    seen = np.array([((other[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(100)])
    assert np.abs(seen - model.false_positive).max() < 1e-3


def test_chance_hits_are_taken_off():
    """A nearly full filter of one language must not win by what it lets through."""
    rng = np.random.default_rng(2)
    own = np.concatenate([k for k, _ in language_id.grams(["some words that are here"])])
    other = rng.integers(0, 2**63, 400_000).astype(np.uint64)
    rows = np.zeros((1 << 16, 1), np.uint64)
    for place in language_id._places(other, len(rows)):
        rows[place, 0] |= np.uint64(1)
    for place in language_id._places(own, len(rows)):
        rows[place, 0] |= np.uint64(2)
    model = language_id.LanguageFilter(["full", "own"], rows)
    assert model.false_positive[0] > 0.99
    names, scores = model.predict(["some words here"])
    assert names == ["own"] and scores[0] > 0.9


def test_against_plain_sets(spark, folder):
    rows = sentences(3, 400)
    odd = [(1000, None, "en", None, None), (1001, "", "de", "s", 0), (1002, "12 -- 34", "en", "s", 0),
           (1003, "Der Fuchs", None, "s", 0), (1004, "ψψψ φφφ", None, "s", 0), (1003, "Der Fuchs", None, "s", 0)]
    got = language_id.op12_language_id(spark, folder(documents=(rows + odd, SCHEMA)))
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"
    }
    train = [(t, lang) for i, t, lang, *_ in rows + odd if lang and t is not None and not held_out(i)]
    order = [lang for lang, _ in sorted(Counter(lang for _, lang in train).items(), key=lambda x: (-x[1], x[0]))]
    amounts = {lang: Counter(g for t, own in train if own == lang for g in plain_grams(t)) for lang in order}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in amounts.items()}
    best = Counter()
    for s in share.values():
        for g, x in s.items():
            best[g] = max(best[g], x)
    own = {lang: {g for g, x in s.items() if x >= language_id.NEAR_BEST * best[g]} for lang, s in share.items()}

    def expected(text):
        found = plain_grams(text or "")
        if not found:
            return "und", 0.0
        counts = [sum(g in own[lang] for g in found) for lang in order]
        return order[counts.index(max(counts))], max(counts) / len(found)

    answers = got.collect()
    assert len(answers) == len(rows) + len(odd)
    texts = {i: t for i, t, *_ in rows + odd}
    for r in answers:
        name, score = expected(texts[r.doc_id])
        assert (r.held_out, r.lang_pred) == (held_out(r.doc_id), name)
        assert abs(r.score - score) < 0.01
    truth = {i: lang for i, _, lang, *_ in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in answers if r.doc_id in truth)


def test_held_out_accuracy(spark, duck):
    folder = "/root/testdata/sf0.01"
    truth = dict(duck.execute(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    rows = [r for r in language_id.op12_language_id(spark, folder).collect() if r.held_out]
    assert len(rows) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_nothing_to_learn_from(spark, folder):
    rows = [(1, "some text", None, "s", 0), (2, None, None, None, None)]
    got = language_id.op12_language_id(spark, folder(documents=(rows, SCHEMA))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_empty_table(spark, folder):
    assert language_id.op12_language_id(spark, folder(documents=([], SCHEMA))).count() == 0


@pytest.mark.parametrize("name", ["k0", "_text", "lang_pred", "score", "name"])
def test_clashing_names(spark, name):
    df = spark.createDataFrame([("un deux", "fr", 1), ("one two", "en", 2)], f"body string, tongue string, `{name}` int")
    model = language_id.learn(df, text_col="body", lang_col="tongue")
    out = language_id.identify(df, model, text_col="body", keep=[name])
    assert sorted(tuple(r)[:2] for r in out.collect()) == [(1, "fr"), (2, "en")]


def test_sample_of_a_language_is_bounded(spark):
    rows = [(f"un deux trois {k}", "fr") for k in range(2000)] + [("one two", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    few = language_id.learn(df, training_rows=50)
    assert sorted(few.languages) == ["en", "fr"]
    assert few.predict(["two one", "trois"])[0] == ["en", "fr"]
