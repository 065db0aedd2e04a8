"""Quality, toxicity, language: counts against brute force, held-out accuracy, odd inputs."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import boosting, common, langid, quality, toxicity
from tests.llm.conftest import BAD, GOOD, sentence, thue_morse


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    times = collections.Counter(zip(words, words[1:], words[2:]))
    cover = {k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), len(cover)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, n < 50 or 100 * repeat > 50 * n


def brute_statistics(text):
    """The features of the quality classifier, one text at a time."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    n, m = max(1, len(words)), max(1, len(lines))

    def repeated(k):
        runs = list(zip(*(words[q:] for q in range(k))))
        times = collections.Counter(runs)
        return len({i + q for i, r in enumerate(runs) if times[r] > 1 for q in range(k)}) / n

    out = [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n, math.log1p(len(lines)), len(words) / m, (len(lines) - len(set(lines))) / m]
    out += [len(set(words)) / n, repeated(3), repeated(2), max(collections.Counter(words).values(), default=0) / n]
    kinds = [str.isupper, str.islower, str.isdigit, lambda c: c in "#*$%&|<>=+^~@_\\/{}[]", lambda c: c in "!?", lambda c: c in ".,;:", lambda c: c == "|", lambda c: c in " \t\n\r\x0b\x0c"]
    for kind in kinds:
        out.append(sum(b < 128 and kind(chr(b)) for b in raw) / max(1, len(raw)))
    return [*out, sum(b > 127 for b in raw) / max(1, len(raw))]


def test_statistics(odd_texts):
    one, two = thue_morse(2048)
    texts = odd_texts + [f"{one}\n{two}\n{one}", f"{one} {two} {one} {two}", "a b a b a b", "x\ny\nx\n\n"]
    got = boosting.features(pa.array(texts, pa.string()))
    np.testing.assert_allclose(got, [brute_statistics(t) for t in texts], rtol=1e-12, atol=1e-12)
    assert boosting.features(pa.array([], pa.string())).shape == (0, len(boosting.NAMES))


def labelled_tables(spark, documents, tmp_path, target):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = sentence(i, 55 + i % 20)
        if target == "quality" and bad:
            text += " " + BAD * 3
        if target == "toxic" and bad:
            words = text.split()
            for w in rng.sample(["nitwit", "dunderhead", "numbskull", "blockhead"], 3):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        texts.append(text)
        labels.append((i, int(not bad) if target == "quality" else 0, int(bad) if target == "toxic" else 0))
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts, labels


def test_base_counts(odd_texts):
    one, two = thue_morse(2048)  # of one hash
    texts = odd_texts + [f"{one}\n{two}\n{one}\n{two}", f"x {one} y x {two} y", f"x {one} y x {one} y", "a b c a b c", "x y\nx y\n\n \nx y", "# a\n# a\n", GOOD * 4, "a b a b a b", "é # é"]
    got = quality.judged(pa.array(texts, pa.string()), quality.Model(np.append(np.zeros(3 << quality.BITS), 9.0)))
    for i, t in enumerate(texts):
        assert tuple(got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_counts(t)
    assert quality.judged(pa.array([], pa.string()), quality.Model(np.zeros((3 << quality.BITS) + 1)))["kept"].shape == (0,)


def test_quality_rules(spark, documents, tmp_path, odd_texts):
    sf, texts, labels = labelled_tables(spark, documents, tmp_path, "quality")
    kept = {r["doc_id"]: r["kept"] for r in quality.op3_quality_rules(spark, sf).collect()}
    assert sum(kept[i] == bool(q) for i, q, _ in labels) >= 0.97 * len(labels)
    model = quality.train(spark, documents(texts), spark.read.parquet(f"{sf}/labels.parquet"))
    stage = quality.keep_good(spark, documents(odd_texts + [texts[1]]), model)
    assert stage.schema == documents([]).schema and [r["doc_id"] for r in stage.collect()][-1:] == [len(odd_texts)]
    none = quality.train(spark, documents(texts), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.assess(spark, documents([]), none).count() == 0
    assert quality.assess(spark, documents(odd_texts), none).count() == len(odd_texts)


def test_trees(spark, documents, tmp_path, odd_texts):
    sf, _, labels = labelled_tables(spark, documents, tmp_path, "quality")
    rows = {r["doc_id"]: r for r in boosting.op6_quality_classifier(spark, sf).collect()}
    held = [(i, q) for i, q, _ in labels if rows[i]["held_out"]]
    assert held and sum(rows[i]["predicted"] == q for i, q in held) >= 0.95 * len(held)
    model = boosting.train(spark, documents(odd_texts), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scores = [r["score"] for r in boosting.classify(spark, documents(odd_texts), model).collect()]
    assert len(scores) == len(odd_texts) and all(0 <= s <= 1 for s in scores)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x, y, trees=20)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    def walk(t, row):
        node, inner = 0, model.feature.shape[1]
        while node < inner:
            node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
        return model.leaf[t, node - inner]
    assert np.allclose(model.margin(x[:50]), [model.base + sum(walk(t, row) for t in range(20)) for row in x[:50]])


def test_subsequence_kernel():
    def brute(a, b, n=toxicity.LENGTH, d=toxicity.DECAY):
        from itertools import combinations
        feature = lambda s: collections.Counter()
        def phi(s):
            out = feature(s)
            for at in combinations(range(len(s)), n):
                out[tuple(s[i] for i in at)] += d ** (at[-1] - at[0] + 1)
            return out
        p, q = phi(a), phi(b)
        return sum(v * q[k] for k, v in p.items()) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
    units = [b"idiot", b"idi0ot", b"banana", b"nab", b"abcabc"]
    rows = padded(units)
    marks = toxicity.Landmarks(rows[:3])
    assert np.allclose(marks.kernel(rows), [[brute(a, b) for b in units[:3]] for a in units], atol=1e-5)


def padded(units):
    ends = np.cumsum([len(u) for u in units])
    return toxicity.padded(np.frombuffer(b"".join(units), np.uint8), ends - [len(u) for u in units], ends)


def brute_score(model, learnt, text):
    """The toxicity of one text, unit by unit; ``learnt`` are the units that the machine takes for toxic."""
    value = lambda u: float(model.margins(padded([u]))[0])
    plain = [bytes(b for b in w.lower() if b >= 128 or chr(b).isalnum()) for w in (text or "").encode().split()]
    words, units, k = [w for w in plain if w], [], 0
    while k < len(words):
        n = k + 1
        while len(words[k].decode()) == 1 and n < len(words) and len(words[n].decode()) == 1:
            n += 1
        unit, half = b"".join(words[k:n]), toxicity.SIGNS // 2
        units += [unit] if len(unit) <= 2 * half else [unit[a : a + 2 * half] for a in range(0, len(unit) - half, half)]
        k = n
    units = [u for u in units if len(u) >= toxicity.LENGTH]

    def bits(w, kind):
        forms = {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) >= toxicity.SPOILT else set())
        out = 0
        for i, t in enumerate(learnt):
            parts = {t[:n] for n in range(1, len(t))} if kind == 0 else {t[a:] for a in range(1, len(t))} if kind == 2 else {t[a : a + n] for a in range(len(t)) for n in range(1, len(t) - a + 1)}
            out |= (1 << i % 64) if forms & parts else 0
        return out

    found, most = {}, max(map(len, learnt), default=0)
    for i in range(len(words)):
        for k in range(1, toxicity.JOINED):
            part = words[i : i + k + 1]
            u = b"".join(part)
            if len(part) <= k or any(len(w) > toxicity.SIGNS for w in part) or not toxicity.LENGTH <= len(u) <= min(toxicity.SIGNS, most + k + 1):
                continue
            live = bits(part[0], 0) & bits(part[-1], 2)
            for w in part[1:-1]:
                live &= bits(w, 1)
            if live and value(u) > max(0, *(value(w) for w in part)) and value(u) > found.get(i, (b"", -9))[1]:
                found[i] = u, value(u)
    at = lambda i: found.get(i, (b"", -9))[1]
    joined = [u for i, (u, v) in found.items() if all(v >= at(i + k) and v > at(i - k) for k in range(1, toxicity.JOINED))]
    clip = lambda u: min(2, max(-2, value(u)))
    soft = sum(1 / (1 + math.exp(-6 * clip(u))) for u in units + joined)
    top = sorted((clip(u) for u in {*units, *joined}), reverse=True)[:3]
    x = [*top, *[-2.0] * (3 - len(top)), math.log1p(soft), math.log1p(100 * soft / max(1, len(units)))]
    return 1 / (1 + math.exp(-np.dot(model.text, [*x, 1])))


def test_toxicity_scores_are_those_of_single_units():
    units = [b"nitwit", b"dunderhead", b"walking", b"reader"]
    rows = padded(units)
    marks = toxicity.Landmarks(rows)
    model = toxicity.Model(marks, np.array([1.6, 1.4, -0.5, -0.5], np.float32), -0.4, toxicity.Parts(rows[:2]), np.array([1.0, 0.5, 0.2, 0.3, 0.4, -1.0]))
    texts = [None, "", "...", "a nit wit", "nit wit nitwit nitwit", "d u n d e r head walking", "dun x der head of ni twit", "nitwitnitwitnitwitnitwit reader", "É nItWiTé dunder-heads", "n i t w i t dunder hea d", sentence(3)]
    for _ in range(2):  # new units, then remembered ones
        assert np.allclose(model.scores(pa.array(texts, pa.string())), [brute_score(model, units[:2], t) for t in texts], atol=1e-5)
    assert model.scores(pa.array([], pa.string())).shape == (0,)


def test_machine_is_the_best_of_its_loss():
    rng = np.random.default_rng(4)
    x, up, down = rng.standard_normal((200, 3)), rng.random(200), rng.random(200)
    w, b = toxicity.svm(x, up, down, ridge=1e-3, steps=50)
    def loss(v):
        z = x @ v[:3] + v[3]
        return up @ np.maximum(0, 1 - z) ** 2 + down @ np.maximum(0, 1 + z) ** 2 + 1e-3 * v[:3] @ v[:3]
    best = np.append(w, b).astype(float)
    assert all(loss(best) <= loss(best + s * step) + 1e-6 for s in (0.05, -0.05) for step in np.eye(4))


def test_toxicity(spark, documents, tmp_path, odd_texts, monkeypatch):
    monkeypatch.setattr(toxicity, "LANDMARKS", 16)
    sf, texts, labels = labelled_tables(spark, documents, tmp_path, "toxic")
    # repeated rows and rows with one id
    documents([texts[1], texts[1], "nitwit again"], [1, 900, 900]).write.mode("append").parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    held = [(i, t) for i, _, t in labels if rows[i]["held_out"]]
    assert held and sum(rows[i]["predicted"] == t for i, t in held) >= 0.9 * len(held)
    model = toxicity.train(spark, documents(texts), spark.read.parquet(f"{sf}/labels.parquet"))
    spoilt = GOOD + " n-i-t-w-i-t " + GOOD + " b l o c k h e a d and dunder.head numb0skull nit wit"
    clean, toxic = model.scores(pa.array([GOOD, spoilt]))
    assert clean < 0.3 <= toxic
    assert all(0 <= s <= 1 for s in model.scores(pa.array(odd_texts, pa.string())))
    none = toxicity.train(spark, documents(texts), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.classify(spark, documents(odd_texts), none).count() == len(odd_texts)
    assert toxicity.classify(spark, documents([]), none).count() == 0


def test_code_lengths_are_exact():
    rng = random.Random(1)
    train, test = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(2)]
    buf, offsets = common.texts(pa.array([train, test, "zz"]))
    w = langid.windows(buf, offsets)
    tree = langid.ContextTree(w[: offsets[1]])
    seen = [collections.defaultdict(collections.Counter) for _ in range(langid.ORDER + 1)]
    raw = b"\0" * langid.ORDER + train.encode()
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER + 1):
            seen[k][raw[i - k : i]][raw[i]] += 1
    def brute(text):
        raw, bits = b"\0" * langid.ORDER + text.encode(), 0.0
        for i in range(langid.ORDER, len(raw)):
            for k in range(langid.ORDER, -1, -1):
                c = seen[k].get(raw[i - k : i])
                if c is None:
                    continue
                total = sum(c.values()) + len(c)
                if raw[i] in c:
                    bits += math.log2(total / c[raw[i]])
                    break
                bits += math.log2(total / len(c))
            else:
                bits += 8
        return bits
    got = tree.bits(w)
    for k, text in enumerate([train, test, "zz"]):
        assert got[offsets[k] : offsets[k + 1]].sum() == pytest.approx(brute(text), rel=1e-5)
    model = langid.Model({"x": tree, "y": tree})
    langs, score, _ = model.judge(pa.array([train, None, "12 !", ""], pa.string()))
    assert langs == ["x", "und", "und", "und"] and score.tolist() == [0.5, 0, 0, 0]


def test_language_stage(spark, documents, odd_texts, tmp_path):
    other = "der schnelle braune fuchs springt über den faulen hund und viele leser gehen ruhig am grünen fluss entlang"
    rows = [(i, (GOOD if i % 2 else other) + f" {i}", "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op10_language_id(spark, str(tmp_path)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60]) and got[100]["lang_pred"] == "und"
    model = langid.train(spark, docs)
    stage = langid.keep_known(spark, documents(odd_texts), model)
    assert stage.schema == documents([]).schema
    assert [r["doc_id"] for r in stage.collect()] == [i for i, t in enumerate(odd_texts) if t and re.search("[^\\W\\d_]", t)]
    empty = langid.train(spark, docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(spark, docs, empty).collect()} == {"und"}


def test_split_insults_are_toxic(spark, documents, tmp_path):
    """Insults broken into pieces of any length, some too short to be units of their own."""
    sf, _, _ = labelled_tables(spark, documents, tmp_path, "toxic")
    model = toxicity.train(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [sentence(1000 + i) for i in range(20)]
    broken = ["nit wit", "ni tw it", "d under head", "num bsk ull", "bl ock head", "dunder head", "n um bs kull", "blockh ead"]
    top = lambda texts: model.text_features(*common.texts(pa.array(texts)))[:, 0]
    whole = top([t.replace(" ", f" {broken[i % 8].replace(' ', '')} ", 1) for i, t in enumerate(clean)])
    found = top([t.replace(" ", f" {broken[i % 8]} ", 1) for i, t in enumerate(clean)])
    assert (whole > 0).all() and (found >= whole - 1e-4).all()


def test_one_class_one_language_and_repeated_rows(spark, documents):
    texts = [sentence(k, 60) for k in range(12)]
    docs = documents([*texts, texts[0], texts[0]], [*range(12), 0, 0])
    ones = spark.createDataFrame([(i, 1, 1) for i in range(12)], "doc_id long, quality int, toxic int")
    for module, column in ((boosting, "score"), (toxicity, "score"), (quality, "probability")):
        model = module.train(spark, docs, ones)
        judge = module.assess if module is quality else module.classify
        rows = judge(spark, docs, model).collect()
        assert len(rows) == 14 and all(r[column] > 0.5 for r in rows) and len({r[column] for r in rows if r["doc_id"] == 0}) == 1
        assert judge(spark, documents([]), model).count() == 0
    rows = langid.identify(spark, docs, langid.train(spark, docs)).collect()
    assert len(rows) == 14 and {(r["lang_pred"], r["score"]) for r in rows} == {("en", 1.0)}
    assert langid.train(spark, documents([])).languages == []


def test_probability_at_the_threshold_is_kept():
    weights = np.zeros((3 << quality.BITS) + 1)
    margin = math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    text = pa.array([sentence(1, 60)])
    for shift, kept in ((1e-9, True), (-1e-9, False)):
        weights[-1] = margin + shift
        assert quality.judged(text, quality.Model(weights))["kept"].tolist() == [kept]


def test_bounded_sample(spark):
    rows = spark.range(40000).selectExpr("CASE WHEN id < 39990 THEN id % 5000 ELSE id END AS k", "IF(id < 39990, 'a', 'b') AS g")
    got = common.bounded_sample(rows, ["g"], "k", 300).collect()
    assert sum(r["g"] == "a" for r in got) == 300 and sum(r["g"] == "b" for r in got) == 10 and len(got) == len(set(got))
    assert sorted(got) == sorted(common.bounded_sample(rows.repartition(5), ["g"], "k", 300).collect())
