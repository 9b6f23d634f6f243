"""Networks and rules as tables."""

import ipaddress
import random
import re

import pytest

from gateledger.operators import networks, rulejoin


def test_address_bits(spark):
    texts = [
        "1.2.3.4", "255.255.255.255", "1.2.3", "01.2.3.4", "1.2.3.256", "", "::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:2:3", "2001:DB8::FF", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
        "::1.2.3", "g::1", "12345::", ":1", "1:", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "x.y", "1.2.3.4:80",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = {r.ip: r.bits for r in df.withColumn("bits", networks.address_bits(df.ip)).collect()}
    for t in texts:
        try:
            address = ipaddress.ip_address(t)
            want = format(int(address), f"0{address.max_prefixlen}b")
        except ValueError:
            want = None
        assert got[t] == want, t


@pytest.mark.parametrize("longest", [False, True])
def test_network_owners(spark, longest):
    rng = random.Random(2)
    nets = []
    for k in range(400):
        if k % 4:
            n = ipaddress.ip_network((rng.getrandbits(3) << 29 | rng.getrandbits(29), rng.choice([0, 3, 4, 8, 12, 31, 32])), strict=False)
        else:
            n = ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(8) << 88, rng.choice([32, 36, 40, 128])), strict=False)
        nets.append((k, str(n), f"team {k}"))
    bad = [(900, "10.0.0.0/33", "x"), (901, "nowhere/8", "x"), (902, None, "x"), (903, "1.2.3.4/", "x")]
    rows = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)]
    rows += [str(ipaddress.ip_address(0x20010DB8 << 96 | rng.getrandbits(96))) for _ in range(60)] + ["nothing", None, "1.2.3.4", "1.2.3.4"]
    df = spark.createDataFrame([(i, r, "own") for i, r in enumerate(rows)], "n long, client_ip string, prefix string")
    table = spark.createDataFrame(nets + bad, "position long, cidr string, team string")
    assert networks.malformed_networks(table).count() == len(bad)
    out = networks.network_owners(df, table, carry=("team",), longest=longest)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    got = {r.n: (r.network, r.team, r.prefix) for r in out.collect()}
    assert len(got) == len(rows)
    parsed = [(k, ipaddress.ip_network(c), c, t) for k, c, t in nets]
    for i, text in enumerate(rows):
        try:
            address = ipaddress.ip_address(text)
            held = [(-n.prefixlen if longest else 0, k, c, t) for k, n, c, t in parsed if address in n]
        except ValueError:
            held = []
        assert got[i] == ((*min(held)[2:], "own") if held else (None, None, "own"))


def test_no_networks(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "client_ip string")
    empty = spark.createDataFrame([], "position long, cidr string")
    assert networks.network_owners(df, empty).first().network is None


@pytest.mark.parametrize("pattern, literal", [
    ("abc", "abc"), ("(?i)Secret Key", "secret key"), (r"\bab(cd)+ef\b", "abcd"), ("a|bcd", None), ("ab?cdef", "cdef"),
    ("(?:abc|abd)xyz", "xyz"), (r"[abc]{4,}", None), ("abc*de", None), (r"x\d+token=", "token="), ("(unclosed", None), ("s?id", None),
])
def test_required_literal(pattern, literal):
    assert rulejoin.required_literal(pattern) == literal


def test_rule_matches(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(300)]
    rules = [(i, w if i % 3 else f"(?i){w.upper()}\\d*|{w}x") for i, w in enumerate(words)]
    rules += [(1000, r"\d{6}"), (1001, r"^start"), (1002, words[1]), (1003, None), (1004, "token=[a-z]+"), (1005, "(?i)İstan")]
    texts = [" ".join(rng.sample(words, 6)) + ("1" * rng.randint(0, 8)) for _ in range(150)]
    texts += ["start here", "a token=abc", "TOKEN=abc", None, "", "start here", "ab\ntoken=z", "x" * 200_000 + "token=q", "istan"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(rules, "rule_id long, pattern string")
    got = sorted((r.doc_id, r.rule_id) for r in rulejoin.rule_matches(df, table, "doc_id").collect())
    want = sorted(
        (i, k) for i, t in enumerate(texts) if t is not None for k, p in rules if p is not None and k != 1005 and re.search(p, t))
    assert [g for g in got if g[1] != 1005] == want
    with pytest.raises(ValueError, match="required literal"):
        rulejoin.rule_matches(df, table, "doc_id", inline_limit=1)


def test_whole_words_are_joined(spark, monkeypatch):
    """Rules for whole words leave nothing to test, however many share their syllables."""
    rng = random.Random(6)
    words = ["".join(rng.choice(("ban", "Lor", "mi", "tek")) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    around = (r"(^|[^A-Za-z])%s([^A-Za-z]|$)", r"(?i)(?:^|[^a-zA-Z])%s(?:[^A-Za-z]|$)", r"(?<![A-Za-z])%s(?![A-Za-z])", "(?i)%s")
    rules = [(i, around[i % 4] % w) for i, w in enumerate(words)]
    joints = (" ", "_", "7", "é", "\n", "ſ", "", "-")
    texts = ["".join(rng.choice((w, w.upper(), w.lower())) + rng.choice(joints) for w in rng.sample(words, 12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(rules, "rule_id long, pattern string")
    index = {r.pattern: r for r in rulejoin.indexed(table).collect()}
    for i, pattern in rules:
        row = index[pattern]
        assert (row.word is None, row.piece is not None) == (i % 4 == 3, i % 4 == 3 and len(words[i]) >= 3)
    monkeypatch.setattr(rulejoin, "TOGETHER", 4)
    got = sorted((r.doc_id, r.rule_id) for r in rulejoin.rule_matches(df, table, "doc_id").collect())
    assert got == sorted((d, i) for d, t in enumerate(texts) for i, p in rules if re.search(p, t, re.ASCII))
