"""Letters, names that clash with results, article structure, and the ordinal fit against plain Python."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import bpe, classifier, html_main, langid, mixing, pii, quality_rules


def test_words_are_letters_and_their_marks():
    assert langid.words_of("½ ② Ⅷ ①② 12 _ ٣") == []
    assert langid.words_of("Straße x² हिन्दी áb 東京") == ["straße", "x", "हिन्दी", "áb", "東京"]
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(32, 0x600), *range(0x900, 0xA00), *range(0x2070, 0x2190), *range(0x4E00, 0x4E40), *range(0x1D400, 0x1D440)) if unicodedata.category(chr(c)) != "Cn"]
    for _ in range(300):
        text = "".join(rng.choices(pool, k=60)).lower()
        want, word = [], ""
        for c in text + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or kind == "M" and word:
                word += c
            elif word:
                want.append(word)
                word = ""
        assert langid.words_of(text) == want


def test_no_letter_is_undetermined(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "Ⅷ", "①②", "12", "the cat sat on the mat"])], "doc_id long, text string")
    model = langid.fit(df.withColumn("lang", F.lit("en")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4 and got[4][0] == "en"


def test_more_languages_than_four_thousand(spark):
    df = spark.range(4200).select("id", F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang"))
    assert len(langid.fit(df, id_col="id").langs) == 4200


def test_word_scores_brute():
    """Counts and scores of one word from hashes made letter by letter."""
    cells, m = 1 << 12, 1 << 32
    words = ["cat", "straße", "x"]

    def cells_of(word):
        codes = [ord(c) for c in f"<{word}>"]
        out = []
        for n in range(1, 5):
            for i in range(len(codes) - n + 1):
                h = codes[i] * 0x9E3779B1 % m
                for k in range(1, n):
                    h = (h * 31 + codes[i + k] * 0x9E3779B1) % m
                    h ^= h >> 15
                out.append((h + n * 77) % m % cells)
        w = sum((c + 1) * ((i * 2654435761 + 0x9E3779B1) % m | 1) for i, c in enumerate(codes)) % m
        w ^= w >> 13
        return [*out, w * 0x9E3779B1 % m % cells]

    counts = np.zeros((cells, 2))
    for w, k, n in (("cat", 0, 3), ("straße", 1, 2)):
        for c in cells_of(w):
            counts[c, k] += n
    model = langid.Model(["a", "b"], counts, np.array([3.0, 2.0]), np.array([3.0, 2.0]), {"latin": np.array([3.0, 2.0])})
    got = model.scores(words)
    for w, row in zip(words, got, strict=True):
        s = [langid.SCALE * sum(math.log((counts[c, k] + 0.5) / (counts[:, k].sum() + 0.5 * cells)) for c in cells_of(w)) for k in (0, 1)]
        assert row == pytest.approx([x - max(s) for x in s], abs=1e-3)


def test_names_of_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "the cat sat on a mat", "s"), (2, None, None)], "doc_id long, text string, source string")
    for c in ("kept", "IDS", "copy_no", "n_copies", "mix_key", "_hot", "_mix_src", "p_good", "n_values", "_p_new", "log_ratio", "n_words", "_bpe_text", "_q_words"):
        df = df.withColumn(c, F.lit("clash"))
    trusted = df.select(F.col("doc_id").alias("id"))
    model = classifier.Model(np.zeros(64), np.array([-1.0, 0.0]))
    for out in (classifier.score(df, model), bpe.encode(df), mixing.mix(df, size=20.0), quality_rules.judge(df, trusted), pii.pseudonymise(df, "k"), bpe.decode(bpe.encode(df).withColumn("text", F.lit(1)))):
        low = [c.lower() for c in out.columns]
        assert len(low) == len({*low}) and len(out.collect()) >= 2, out.columns
    assert mixing.mix(df, size=20.0).select("_hot", "_mix_src").distinct().collect() == [("clash", "clash")]


def test_article_text_is_not_judged_by_class_names():
    page = '<article><header><h1>Title</h1><p>By me</p></header><p class="alert">Flood alert</p><p class="search-result">Body</p><table class="share-prices"><tr><td>1</td></tr></table><div class="search-result">found</div><div class="ad">Buy</div><section id="comment-list"><p>I say</p></section></article>'
    assert html_main.blocks(page) == (["Title", "Flood alert", "Body", "1", "found"], True)
    assert html_main.blocks("<!-- <article>x</article> --><p>y</p>") == (["y"], False)


def test_pages_against_their_making(spark):
    """Pages made from trees of text and of what is no text give the text back."""
    rng = random.Random(12)
    chrome = ["<nav><p>{}</p></nav>", "<aside>{}</aside>", "<form><p>{}</p></form>", '<div class="ad">{}</div>', "<!-- <p>{}</p> -->", "<script>'<p>{}'</script>", "<style>{}</style>", '<section class="comments"><p>{}</p></section>', "<footer>{}</footer>", '<div class="cookie-notice">{}</div>']

    def words():
        return " ".join(rng.choice("alpha beta gamma délta épsilon zeta".split()) for _ in range(rng.randint(1, 7)))

    def tree(depth, out):
        html = ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.randrange(5)
            if kind == 0 and depth < 3:
                html += f'<div class="c{rng.randrange(9)}">' + tree(depth + 1, out) + "</div>"
            elif kind == 1:
                html += rng.choice(chrome).format("noise")
            else:
                a, b = words(), words()
                tag = rng.choice(["p", "h2", "li", "blockquote", "td"])
                html += f"<{tag}> {a}  <b>&amp;&eacute;</b>\n{b}<br>&#955;</{tag}>"
                out.append(f"{a} &é {b} λ")
        return html

    rows, want = [], {}
    for i in range(200):
        out: list = []
        body = tree(0, out)
        rows.append((i, f"https://h{i % 3}.org/{i}", f"<html><head><title>t</title></head><body><nav>menu</nav><article>{body}</article><footer>end</footer></body></html>"))
        want[i] = "\n".join(out)
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_ordinal_fit_brute():
    """The fit stands where no direction of the penalised likelihood, written out row by row, leads down."""
    rng = random.Random(4)
    rows, grades = [], []
    for _ in range(240):
        g = rng.choice([0, 1, 2])
        rows.append(sorted({rng.randrange(12) for _ in range(4)} | ({12 + g} if rng.random() < 0.8 else set())))
        grades.append(g)
    l1 = 2e-3
    m = classifier.fit_arrays(np.concatenate([np.array(r) for r in rows]), np.array([len(r) for r in rows]), np.array(grades), 16, l1=l1, rounds=4000, rare=1)

    def loss(w, theta):
        s = 0.0
        for r, g in zip(rows, grades, strict=True):
            f = sum(w[c] for c in r)
            at = lambda k: 1.0 if k > 1 else 0.0 if k < 0 else 1 / (1 + math.exp(f - theta[k]))  # noqa: B023,E731
            s -= math.log(max(at(g) - at(g - 1), 1e-12))
        return s / len(rows) + l1 * sum(map(abs, w))

    w, theta = m.weights.tolist(), m.thresholds.tolist()
    assert theta[0] < theta[1] and any(w)
    best = loss(w, theta)
    for step in (1e-3, -1e-3, 0.05, -0.05):
        for k in range(16):
            assert loss([x + step * (j == k) for j, x in enumerate(w)], theta) >= best - 2e-6
        for k in range(2):
            assert loss(w, [x + step * (j == k) for j, x in enumerate(theta)]) >= best - 2e-6
    scores = np.array([-2.0, 0.3])
    expected, good = m.grades(scores)
    for s, e, p in zip(scores, expected, good, strict=True):
        above = [1 / (1 + math.exp(t - s)) for t in theta]
        assert e == pytest.approx(sum(above)) and p == pytest.approx(above[-1])


def test_a_text_without_spaces_is_cut_and_repaired():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(bpe.default_tokenizer()), bpe.Reuse(bpe.default_tokenizer(), 64)
    rng = random.Random(2)
    shared = "".join(rng.choice("東京都市大学日本語文章。、") for _ in range(3000))
    for text in (shared, "前" + shared, shared + "x\n\n\nthe", "a" * 50_000, "\n" * 3000 + "x", shared.replace("。", "<|endoftext|>")):
        assert mine.encode(text) == whole.encode(text, add_special_tokens=False).ids
    assert mine.hits > 20 and mine.repairs > 20
