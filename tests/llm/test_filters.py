"""Toxicity, quality rules and license scans."""

import random
import re
import zlib

import numpy as np

from gateledger.llm import licenses, quality, toxicity
from tests.llm.helpers import as_dict, awkward, odd_texts, words


def test_folding_exceptions_and_borders():
    match = toxicity.Matcher(toxicity.Lexicon({"idiot": 2.0, "trash": 1.0, "stupi*": 1.5}, ("trash can",)))
    assert match.weigh("such an 1D10T here")[0] == 1
    assert match.weigh("an іdіоt (look-alike letters)")[0] == 1
    assert match.weigh("idiot### TRASH!! stupidity")[0] == 3
    assert match.weigh("the trash can is full")[0] == 0
    assert match.weigh("trash can, trash")[0] == 1
    assert match.weigh("idiotic nontrash")[0] == 0
    assert match.weigh("")[0] == 0
    short, long_ = match.weigh("idiot you"), match.weigh("idiot " + "word " * 99)
    assert short[1] > long_[1] == 2.0


def test_lexicon_is_learned_and_held_out_rows_are_not_used(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        held = zlib.crc32(str(i).encode()) % 5 == 0
        text = words(rng, 40)
        if toxic:
            text += " zorkhead" if not held else " quibbler"
        texts.append((i, text))
        labels.append((i, 1, int(toxic), "z"))
    docs = awkward(spark, texts + [(1000, None), (1001, "")])
    marks = spark.createDataFrame(labels + [(5, None, None, "")], "doc_id long, quality int, toxic int, text string")
    lexicon = toxicity.fit(docs, marks, min_docs=5)
    assert any(t.startswith("zork") for t in lexicon.terms)
    assert not any(t.startswith("quib") for t in lexicon.terms)
    found = as_dict(toxicity.score(docs, lexicon))
    assert len(found) == 402 and all(0 <= r.score <= 1 for r in found.values())
    for i, text in texts:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert found[i].predicted == int("zorkhead" in text)
    assert found[1000].predicted == found[1001].predicted == 0
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    docs = awkward(spark, odd_texts() + [(50, "you stupid moron")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = as_dict(toxicity.score(docs, toxicity.fit(docs, none)))
    assert found[50].predicted == 1 and sum(r.predicted for r in found.values()) == 1
    assert toxicity.score(awkward(spark, []), toxicity.Lexicon({})).count() == 0


def brute_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(ws) - 2):
        windows.setdefault(tuple(ws[i:i + 3]), []).append(i)
    cover = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover))


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    texts = odd_texts()[:3] + odd_texts()[4:]
    for i in range(200):
        letters = rng.choice(["ab \n", "a b\n#", "é ñ|\t\n", "x\x0b\x0cy \xa0z"])
        texts.append((100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))))
    texts.append((900, "w " * 400))
    found = as_dict(quality.rules(awkward(spark, texts), None))
    for doc, text in texts:
        want = brute_counts(text)
        assert tuple(found[doc][c] for c in quality.COUNTS) == want, (doc, text)
        assert found[doc].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (found[doc].base_failed and found[doc].kept)


def test_forest_comes_close_to_the_best_rule():
    rng = np.random.default_rng(0)

    def sample(n):
        x = rng.random((n, 3))
        clean = x[:, 0] + x[:, 1] ** 2
        return x, clean < 0.9, (clean + 0.2 * rng.standard_normal(n) < 0.9)

    x, _, y = sample(4000)
    forest = quality.grow(x, y.astype(float), np.array([-1, -1, 0]))
    x, best, y = sample(4000)
    # the noise leaves the true rule itself wrong on some rows
    assert ((forest.probability(x) > 0.5) == y).mean() > (best == y).mean() - 0.03


def test_constrained_features_never_raise_the_score():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    wavy = x[:, 0] + 0.5 * np.sin(20 * x[:, 0]) + x[:, 1] ** 2 + np.sin(9 * x[:, 2])
    forest = quality.grow(x, (wavy < 0.9).astype(float), np.array([-1, -1, 0]))
    for f in (0, 1):
        grid = np.repeat(rng.random((40, 1, 3)), 60, axis=1)
        grid[:, :, f] = np.linspace(0, 1, 60)
        assert (np.diff(forest.margin(grid.reshape(-1, 3)).reshape(40, 60), axis=1) <= 1e-9).all()


def test_quality_rows_keep_their_columns(spark):
    rng = random.Random(8)
    texts = [(i, words(rng, 80) if i % 2 else "# " * 60 + words(rng, 20)) for i in range(200)]
    docs = awkward(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    forest = quality.fit(docs, labels)
    kept = quality.without_poor(docs, forest)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 2}
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.rules(awkward(spark, []), forest).count() == 0


def test_license_scan_against_brute_force(spark):
    rng = random.Random(9)
    names = list(licenses.TEMPLATES)
    texts = odd_texts()
    for i in range(160):
        filler = words(rng, rng.randint(0, 200)).split()
        if i % 2:
            body = licenses.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randint(0, len(body) // 12)):
                body[rng.randrange(len(body))] = "edit"
            at = rng.randint(0, len(filler))
            filler[at:at] = body
        texts.append((100 + i, " ".join(filler)))
    found = {(r.doc_id, r.license): r for r in licenses.scan_licenses(awkward(spark, texts)).collect()}
    want = set()
    for doc, text in texts:
        ws = licenses.words_of(text or "")
        for name, template in licenses.TEMPLATES.items():
            t = licenses.words_of(template)
            k = min(5, len(t))
            need = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
            span = int(1.25 * len(t)) + 1
            best = max((len(need & {tuple(ws[j:j + k]) for j in range(s, min(len(ws), s + span) - k + 1)})
                        for s in range(len(ws))), default=0) if set(ws) & set(t) else 0
            if best >= 0.8 * len(need):
                want.add((doc, name))
    # windows are larger than the span of the brute force, so they may hold a little more
    assert want <= set(found) and len(set(found) - want) <= 3
    for (doc, name), r in found.items():
        assert 0.8 <= r.containment <= 1 and r.first_word < r.end_word, (doc, name)
    assert licenses.scan_licenses(awkward(spark, [])).count() == 0
    assert licenses.scan_licenses(awkward(spark, texts), templates={}).count() == 0


def test_null_id_is_held_out_by_its_text(spark):
    row = spark.createDataFrame([(None,)], "doc_id long").select(toxicity.held_out().alias("h")).first()
    assert row.h is True
