"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gateledger.llm import dialogues, disclosure, spelling
from gateledger.llm.common import slim, table
from tests.llm.helpers import awkward, odd_texts

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 8 <= len(digits) <= 15
            ):
                found.append((kind, *m.span()))
    return found


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def test_base_spans_of_the_sample(spark, sample):
    got = {r.doc_id: r for r in disclosure.op11_disclosure(spark, sample).collect()}
    docs = table(spark, sample, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want = plain_spans(text or "")
        row = got[doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert row.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert row.spans.startswith(joined(want))


def test_base_spans_of_odd_and_long_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1234.@+- ()_%é\U0001f600\n0") for _ in range(rng.choice([5, 40, 200]))) for _ in range(600)]
    texts += [t for _, t in odd_texts()]
    texts += ["a@b.c_d@e.f a@b.c.d-e@f.g 4111 1111 1111 1111 1.2.3.256 007.0.0.255 +1 (743) 555-3824", "a@b " * 50]
    runs = ["1" * 500_000, "a" * 500_000, "1 " * 200_000, "a.b-" * 100_000 + "@", "+1" * 100_000, "1.2.3.4." * 5_000]
    docs = slim(awkward(spark, list(enumerate(texts + runs))))
    none = spark.createDataFrame([], "term string, generalised string, disclosure double")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in disclosure.with_spans(docs, none).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_spans(text or ""), text
    assert len(got) == len(texts + runs)
    assert got[len(texts)] == got[len(texts) + 1] == []


def plain_disclosing(texts, threshold, contexts):
    """term -> (generalised, disclosure), by counting everything in dictionaries."""
    texts = sorted(set(texts))
    word = re.compile(r"[^\W\d_]\w*")
    of_term, of_entity, both, around = Counter(), defaultdict(set), defaultdict(set), defaultdict(set)

    def known(text):
        found = {w.lower() for w in word.findall(text) if len(w) >= 4}
        return found | {w[: math.ceil(len(w) / 2)] + "*" for w in found}

    for text in texts:
        of_term.update(known(text))
        for kind, pattern in PLAIN.items():
            edges = [0] + [e for m in pattern.finditer(text) for e in m.span()] + [len(text)]
            spans = plain_spans(text)
            for k, m in enumerate(pattern.finditer(text)):
                if (kind, *m.span()) not in spans:
                    continue
                value = m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())
                left, right = text[edges[2 * k]:m.start()], text[m.end():edges[2 * k + 3]]
                assert len(left) <= 200 and len(right) <= 200  # the texts of this test stay inside the window
                left, right = left.rsplit("\n", 1)[-1], right.split("\n", 1)[0]
                of_entity[f"{kind}:{value}"].add(text)
                for term in known(f"{left} {right}"):
                    both[f"{kind}:{value}", term].add(text)
                    around[f"{kind}:{value}", term].add((left, right))
    share = {}
    for (entity, term), where in both.items():
        information = math.log2(len(texts) / len(of_entity[entity]))
        if len(around[entity, term]) >= contexts and information > 0:
            share[entity, term] = 1 + math.log2(len(where) / of_term[term]) / information
    told = {k: v for k, v in share.items() if v >= threshold}
    found = {}
    for (entity, term), value in told.items():
        if not term.endswith("*"):
            stem = term[: math.ceil(len(term) / 2)] + "*"
            tells, most = found.get(term, (False, 0.0))
            found[term] = (tells or (entity, stem) in told, max(most, value))
    return {t: (None if tells else t[: math.ceil(len(t) / 2)] + "*", v) for t, (tells, v) in found.items()}


def test_disclosing_terms(spark):
    rng = random.Random(8)
    common = ["river", "stone", "table", "green", "window", "mercury", "mercenary", "paper", "zeb"]
    texts = []
    for i in range(60):
        near = " ".join(rng.sample(common, 3))
        texts.append(f"first line {near}\n{near} plain text {i}")
    for i in range(5):
        w = rng.sample(common, 2)
        texts.append(f"intro {i}\n{w[0]} Quxanto {w[1]} mail Jo.Doe@Example.com mercedonia office {i}\nlast")
        texts.append(f"{w[1]} kelvarin {w[0]} call +1 (743) 555-382{i % 2} kelvingo {i}")
    texts += [texts[-1]] * 20 + [None, "", "nothing private: quxanto alone", "mercedonia here"]
    docs = slim(awkward(spark, list(enumerate(texts))))
    told = disclosure.disclosing(docs, threshold=0.6)
    got = {r.term: (r.generalised, round(r.disclosure, 9)) for r in told.collect()}
    want = plain_disclosing([t or "" for t in texts], 0.6, 3)
    assert got == {t: (g, round(v, 9)) for t, (g, v) in want.items()}
    assert got["quxanto"][0] is None and got["mercedonia"][0] == "merce*"
    spanned = disclosure.with_spans(docs, told)
    clean = {r.doc_id: r.text for r in disclosure.sanitised(spanned).collect()}
    for i, text in enumerate(texts):
        assert ("uxanto" not in clean[i]) and "Doe@" not in clean[i] and "mercedonia" not in clean[i]
        if not any(t in (text or "").lower() for t in [*got, "@", "+1"]):
            assert clean[i] == (text or "")
    assert clean[60].splitlines()[1].startswith("[EMAIL] merce* ", clean[60].splitlines()[1].index("[EMAIL]"))


def test_no_private_data(spark):
    docs = slim(awkward(spark, [(1, None), (None, "a text"), (3, "")]))
    assert disclosure.disclosing(docs).count() == 0
    rows = disclosure.with_spans(docs, disclosure.disclosing(docs)).collect()
    assert len(rows) == 3 and all(r.spans == [] for r in rows)
    assert disclosure.disclosing(docs.limit(0)).count() == 0


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            short = w[:k] + w[k + 1:]
            holes[k, short].add(w)
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 2 * n else None
    found = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found[w] = (w, form[w], root, n, len(near[w]), words.get(form[w]))
    return found


def test_variants_of_the_sample(spark, sample):
    got = {r.word: tuple(r) for r in spelling.op12_spelling_variants(spark, sample).collect()}
    rows = table(spark, sample, "documents").select("doc_id", "text").collect()
    assert got == plain_variants(plain_words(rows))


@pytest.mark.parametrize("crowd", [3, 40])
def test_variants_of_made_words(spark, crowd):
    rng = random.Random(4)
    words = {"".join(rng.choice("abeé") for _ in range(rng.randint(5, 7))): rng.randint(3, 40) for _ in range(500)}
    words |= {"".join(rng.sample("aeinto", 6)): rng.randint(3, 9) for _ in range(200)}  # one leaf of anagrams
    words |= {"a" * 4000: 9, "a" * 4001: 30, "a" * 2000 + "b" + "a" * 2000: 3}
    table_ = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: tuple(r) for r in spelling.variants(table_, crowd).collect()}
    assert got == plain_variants(words)


def test_crowded_leaf_by_halves():
    rng = random.Random(6)
    words = sorted({"".join(rng.sample("aeintors", 8)) for _ in range(1500)} | {"xaeintors", "aeintor"})
    tree = spelling.Subtree(words, spelling.LEVELS)
    tree.visitors, tree.theirs = tree.words, tree.own
    x, q = tree._by_halves(0, len(words), spelling.np.arange(len(words)))
    listed = set(zip(tree.words[x], tree.words[q], strict=True))
    for a in words:
        for b in words:
            if len(b) - len(a) in (0, 1) and a != b and spelling.one_edit([a], [b])[0]:
                assert (b, a) in listed


def test_no_words(spark):
    docs = slim(awkward(spark, [(1, None), (2, ""), (3, "12 34"), (None, "é")]))
    assert spelling.variants(spelling.vocabulary(spelling.noisy_words(docs))).count() == 0
    odd = awkward(spark, [(None, "Apple apple APPLE applE"), (4, "apples apples apples")])
    got = {r.word: tuple(r) for r in spelling.variants(spelling.vocabulary(spelling.noisy_words(odd))).collect()}
    assert got == plain_variants(plain_words([(None, "Apple apple APPLE applE"), (4, "apples apples apples")]))


def plain_way(items, start=0, goals=(0, 3)):
    """Cheapest audit by going through all rows with the best audit of each state."""
    flat = []
    for initial, fault, copies in items:
        flat += [(initial, fault)] + [(initial, "b" if fault == "b" else "d")] * (copies - 1)

    def inserts(best):
        grown = True
        while grown:
            grown = False
            for s, (cost, audit) in list(best.items()):
                way = (cost + 5, audit + "I")
                if dialogues.NEXT[s] not in best or way < best[dialogues.NEXT[s]]:
                    best[dialogues.NEXT[s]], grown = way, True
        return best

    best = inserts({start: (0, "")})
    for initial, fault in flat:
        after = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 2, "D")]
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                ways.append((dialogues.NEXT[s], cost + 1 + more, "R"))
                if initial == "u" and s in (0, 1, 3) or initial == "s" and s == 0 or initial == "a" and s == 2:
                    ways.append((dialogues.SYMBOL[initial], cost + more, "K"))
            for to, c, letter in ways:
                if to not in after or (c, audit + letter) < after[to]:
                    after[to] = (c, audit + letter)
        best = inserts(after)
    return min((best[g] for g in goals if g in best), default=None)


def plain_repair(rows):
    convs, found = defaultdict(list), {}
    for conv, turn, role, text in rows:
        convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, items, faults = set(), [], Counter()
        for _, role, text in own:
            ink = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            items.append((role[:1], fault, 1))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit = plain_way(items)
        turns = [r[0] for r in own if r[0] is not None]
        lines, state, left = [], 0, iter(own)
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit == "D":
                continue
            state = dialogues.SYMBOL[row[1][:1]] if edit == "K" else dialogues.NEXT[state]
            role = row[1] if edit == "K" else dialogues.ROLE[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        found[conv] = (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["b"], faults["d"], faults["t"],
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def test_cheapest_ways():
    rng = random.Random(1)
    for _ in range(4000):
        items = [
            (rng.choice("suat "), rng.choice(["", "", "", "t", "b", "d"]), rng.choice([1, 1, 1, 2, 3]))
            for _ in range(rng.randint(0, 9))]
        start, goals = rng.randint(0, 3), rng.choice([(0, 3), (0,), (1,), (2,), (3,)])
        assert dialogues.cheapest(items, start, goals) == plain_way(items, start, goals)


def test_repair_of_the_sample(spark, sample):
    got = {r.conv_id: tuple(r) for r in dialogues.op13_conversation_repair(spark, sample).collect()}
    rows = table(spark, sample, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert got == plain_repair([tuple(r) for r in rows])


@pytest.mark.parametrize("block", [4, 512])
def test_repair_of_long_and_odd_conversations(spark, block):
    rng = random.Random(7)
    rows = [(
        rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(60)]),
        rng.choice(["user", "assistant", "system", "tool", None, "", "s"]),
        rng.choice([None, "", "a.", "b", "c? ", "long text!", "x", " \n"]),
    ) for _ in range(1500)] + [(c, t, r, f"{c} {t}.") for c in range(10, 60) for t, r in enumerate(["user", "assistant"] * 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies long, fault string")
    got = {r.conv_id: tuple(r) for r in dialogues.repair(dialogues.damaged(frame), block, 5).collect()}
    want = plain_repair(rows)
    assert got == {c: w for c, w in want.items() if c in got}
    assert all(want[c][7] == "" for c in want if c not in got)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert dialogues.op13_conversation_repair(spark, str(tmp_path)).count() == 0


def test_all_rows_dropped(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    row = dialogues.op13_conversation_repair(spark, str(tmp_path)).select(F.struct("*")).first()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
