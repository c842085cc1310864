import random

import numpy as np
import pytest

from cairnwork.llm.langid import CODE, HashArray, KneserNey, classify, fit, fitting_lines, fold, folded_lines, label_code, label_languages, sentences

WORDS = {
    "en": "the old house was on a hill and nobody knew who had built it before they went there with their horses".split(),
    "de": "das alte haus stand auf einem hügel und niemand wusste wer es gebaut hatte bevor sie dort hin gingen mit ihren pferden".split(),
    "ru": "старый дом стоял на холме и никто не знал кто его построил прежде чем они пошли туда со своими лошадьми".split(),
}
CODE_LINES = ['let x{0} = foo(&y);', '{{"id": {0}, "ok": false}}', "crates/a/src/mod_{0}.rs:{0}", "SELECT key FROM cap WHERE n >= {0};"]


def sentence(rnd, lang):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(6, 12))).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(2)
    lines = [(lang if rnd.random() < 0.9 else rnd.choice(list(WORDS)), sentence(rnd, lang)) for lang in WORDS for _ in range(300)]
    lines += [(CODE, rnd.choice(CODE_LINES).format(i)) for i in range(300)]
    return fit(lines)


def test_labels():
    given = {"en": "en", "EN_us": "en", " eng ": "en", "English": "en", "ger": "de", "deu": "de", "de-AT": "de", "GERMAN": "de", "zh-Hant-TW": "zh", "chi": "zh", "fre": "fr", "dut": "nl", "uk": "uk", "jpn": "ja", "und": None, "": None, None: None, "n/a": None, "unknown": None, "sv": None, "12": None}
    assert {k: label_code(k) for k in given} == given


def test_probabilities_sum_to_one():
    texts = ["abab abc", "abba", "cab"]
    m = KneserNey([texts, ["xyz"]], order=3)
    vocabulary = sorted(set("".join(texts) + "xyz ")) + ["?"]
    for head in ("", "a", "ab", "zz", "xy"):
        base, _ = m.score([head]) if head else (np.zeros((1, 2)), None)
        del base
        from cairnwork.llm import langid as L

        total = np.zeros(2)
        for c in vocabulary:
            codes, here, _ = L._codes([head + c], m.order)
            at = np.array([m.order + len(head)])
            h = L._hashes(codes, m.order)
            p = np.zeros(2)
            for n in range(m.order, 0, -1):
                row, ok = L._find(m.grams[n], h[n][at])
                if ok[0]:
                    p += m.logp[n][row[0]]
                    break
                row, ok = L._find(m.contexts[n], h[n - 1][at - 1])
                p += m.logw[n][row[0]] if ok[0] else 0
            else:
                p += m.floor
            total += np.exp(p)
        assert np.all(total < 1.02) and np.all(total > 0.9), (head, total)


def test_accuracy_on_held_out_lines(model):
    rnd = random.Random(77)
    right = 0
    for lang in WORDS:
        for _ in range(100):
            right += classify(model, [sentence(rnd, lang)])[0][0] == lang
    assert right >= 298
    assert all(classify(model, [rnd.choice(CODE_LINES).format(rnd.randint(1, 9999))])[0][0] is None for _ in range(100))


def test_documents(model):
    rnd = random.Random(5)
    en, de, ru = (lambda lang: (lambda: sentence(rnd, lang)))("en"), (lambda: sentence(rnd, "de")), (lambda: sentence(rnd, "ru"))
    text = "\n".join(["# " + en(), "", "```", "let x1 = foo(&y);", "```", "> " + de(), "- [ ] " + en() + " " + en(), "12.5 | 3.4 | 9.9", "🚀", ru().upper()])
    whole, sure, lines = classify(model, [text])[0]
    assert whole == "en" and 0 < sure <= 1
    assert [(n, x) for n, x, _ in lines] == [(1, "en"), (6, "de"), (7, "en"), (10, "ru")] and all(0 < c <= 1 for _, _, c in lines)
    for nothing in (None, "", " \n\t", "12 34\n==", "let x2 = foo(&y);\ncrates/a/src/mod_3.rs:3", "🚀🚀"):
        assert classify(model, [nothing])[0] == (None, 0.0, [])
    assert classify(model, [" ".join(sentence(rnd, "de") for _ in range(3000))])[0][0] == "de"
    assert classify(model, []) == []


def test_most_letters_decide(model):
    rnd = random.Random(6)
    mixed = sentence(rnd, "de") + " " + " ".join(sentence(rnd, "ru") for _ in range(4))
    assert classify(model, [mixed])[0][0] == "ru"


def test_frame(spark, model):
    rnd = random.Random(8)
    docs = [(1, sentence(rnd, "en"), "English", "x"), (2, sentence(rnd, "de"), "en", "x"), (3, None, "en", "x"), (4, sentence(rnd, "ru") + "\n" + sentence(rnd, "en"), None, "x"), (5, "", "und", "x"), (5, "", "und", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, line_no string")
    got = label_languages(df, "doc_id", "text", "lang", model)
    assert got.columns == ["doc_id", "line_no", "lang", "confidence", "stated"]
    out = sorted((r["doc_id"], r["line_no"], r["lang"] or "", r["stated"] or "") for r in got.collect())
    assert out[:3] == [(1, 0, "en", "en"), (2, 0, "de", "en"), (3, 0, "", "en")]
    assert [x[:3] for x in out if x[0] == 4][1:] == [(4, 1, "ru"), (4, 2, "en")] and [x for x in out if x[0] == 5] == [(5, 0, "", "")] * 2
    assert label_languages(df.limit(0), "doc_id", "text", "lang", model).collect() == []


def test_fitting_sample_is_bounded(spark):
    rnd = random.Random(9)
    docs = [(i, "\n".join([sentence(rnd, "en") for _ in range(6)] + ["```", f"let x{i} = foo(&y);", "```"]), "en") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lines = fitting_lines(df, "text", "lang", fit_lines=60)
    by = {k: sum(x == k for x, _ in lines) for k, _ in lines}
    assert 0 < by["en"] <= 60 and 0 < by[CODE] <= 60
    assert sorted(lines) == sorted(fitting_lines(df.repartition(5), "text", "lang", fit_lines=60))
    assert fitting_lines(df.limit(0), "text", "lang") == []
    empty = fit([])
    assert classify(empty, ["Hello there, world."])[0][0] in (None, "en")


def test_folding():
    assert fold("2025-10-19T00:20:00Z [74] They're 12 both  right.") == "they're 00 both right."
    assert fold("- [ ] 3. X") == "x" and sentences("a.rs `code` 123") != [] and sentences("== 12 ==") == []


def test_long_sentences_are_scored_in_parts(model):
    """A sentence longer than a lot has the sums of its parts; folding a text folds its lines."""
    word = "старый дом стоял на холме и никто не знал "
    assert classify(model, [word * 4000])[0][0] == "ru"
    one, n = model.models.score([word * 10])
    many, m = model.models.score([word * 10] * 3 + [""])
    assert np.allclose(many[:3], one) and m.tolist()[:3] == [n[0]] * 3
    text = "- [ ] Ab  cd e \r\n\n> 12. X​y 7\n\t"
    assert folded_lines(text) == [fold(x) for x in text.split("\n")] == ["ab cd e", "", "x y 0", ""]


def test_places_of_hashes():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        at, there = HashArray(keys).find(wanted)
        assert there.tolist() == np.isin(wanted, keys).tolist() and (keys[at[there]] == wanted[there]).all()
