"""Source divergence, secret scan and prefix trie against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quillon.llm import divergence, prefixtrie, queries, secrets

TABLES = ["documents", "conversations"]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in want.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


# 11 -----------------------------------------------------------------------------------------------


def divergence_by_hand(rows, top, min_docs):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(lang or "", source or "", Counter(cut(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in own for t in c)
        kept = [t for t in seen if seen[t] >= min_docs]
        counts = defaultdict(Counter)
        for _, s, c in own:
            counts[s].update({t: n for t, n in c.items() if seen[t] >= min_docs})
        whole = sum(counts.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))

        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in counts.items():
            parts = {"pair": [(-sum(f(p(c, t), p(counts[o], t)) for t in kept), o) for o in counts if o != s]}
            parts["term"] = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in parts.items():
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, o, -v, r + 1) for r, (v, o) in enumerate(found[: top if part == "term" else None])]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz' * (i // 10)}" for i in range(60)] + ["Ünï", "漢字", "😀", "ünï", "a" * 300, "a" * 299 + "b"]
    rows = [(None, None, None), ("", "en", "s0"), ("12 ,.", "xx", "s9"), ("lone", "yy", None), ("A-b_c\x00d", "en", "s1")]
    for k in range(150):
        few = rng.choice([words, words[:9], words[30:]])
        rows.append((" ".join(rng.choices(few, k=rng.choice([1, 5, 40]))), rng.choice(["en", "en", "en", "de"]), f"s{min(rng.randrange(9), rng.randrange(9))}" if k % 7 else None))
    rows += [rows[20]] * 40 + [(" ".join(words * 300), "en", "s2")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, c int, term string, n int")
    for top, least in ((10, 10), (3, 2)):
        assert sorted(map(tuple, divergence.divergence(df, top, least).collect())) == divergence_by_hand(rows, top, least)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_radix_top_breaks_ties_by_bytes(spark):
    rng = random.Random(3)
    items = ["", "a", "ab", "a\x00", "é", "z", "漢", "😀", "￿"] + ["p" * 500 + x for x in ("", "a", "b", "ba", "é")] + [f"i{k}" for k in range(400)]
    rows = [(g, i, rng.choice([0, 5, 5, 5, 2**40, 2**62])) for g in ("x", None, "y") if g for i in rng.sample(items, 200)] + [("one", "i", 0)]
    got = divergence.radix_top(spark.createDataFrame(rows, "g string, item string, value long"), ["g"], 90).collect()
    want = []
    for g in ("x", "y", "one"):
        own = sorted(((-v, i.encode(), i) for h, i, v in rows if h == g))[:90]
        want += [(g, i, -v, r + 1) for r, (v, _, i) in enumerate(own)]
    assert sorted((r.g, r["item"], r.value, r["rank"]) for r in got) == sorted(want)


# 12 -----------------------------------------------------------------------------------------------

ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secrets.BASE[k]) for a, k, b in sorted(out)]


def test_base_spans_are_those_of_a_search():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apiKey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEF12", "abcdef0123456789", "0a", "g", "é", "漢", "😀", "\n", "+/_.=-", "xyz", "deadbeef" * 3, "ghp_", "İ"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 25)))
        assert [s for s in secrets.find_spans(text) if s[2] in secrets.BASE] == base_by_hand(text), text


def base62(body):
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = secrets.BASE62[r] + out
    return body + out


def base58(payload):
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = secrets.BASE58[r] + out
    return out


#: Published examples of the formats, and some made here by other code than that under test.
VALID = {
    "nostr": "nsec10allq0gjx7fddtzef0ax00mdps9t2kmtrldkyjfs8l5xruwvh2dq0lhhkp",
    "wif": "5HueCGU8rMjxEXxiPuD5BDku4MkFqeZyd4dZ1jvhTVqvbTLvyTJ",
    "xprv": "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi",
    "github": "gho_" + base62("Ab3dEf6h1jKlMn0pQrStUvWxYz1234"),
    "npm": "npm_" + base62("a" * 30),
}


@pytest.mark.parametrize("kind", VALID)
def test_checksums_decide(kind):
    key = VALID[kind]
    lead = "é my private key: " if kind == "wif" else "é "
    kinds = lambda text: [(text[a:b], k) for a, b, k in secrets.find_spans(text) if k not in secrets.BASE]
    assert kinds(f"{lead}{key} end") == [(key, kind)]
    for i in range(len(key) - 12, len(key)):
        wrong = key[:i] + ("b" if key[i] != "b" else "c") + key[i + 1 :]
        assert kinds(f"{lead}{wrong} end") == []
    assert kinds(lead + key + "x") == [] and kinds(f"nothing near {'x' * 60} {key}") == ([] if kind == "wif" else [(key, kind)])


def test_own_keys_of_each_format():
    wif = base58(b"\x80" + bytes(range(32)) + b"\x01")
    assert [k for *_, k in secrets.find_spans(f"wallet wif {wif} and wif {wif}")] == ["wif", "wif"]
    assert secrets.bech32("A12UEL5L") and secrets.bech32("a12uel5l") and not secrets.bech32("A12uEL5L")
    assert secrets.crc16_base32("SBFGFF27Y64ZUGFAIG5AMJGQODZZKV2YQKAVUUN4HNE24XZXD2OEUVUP") is secrets.crc16_base32("SBFGFF27Y64ZUGFAIG5AMJGQODZZKV2YQKAVUUN4HNE24XZXD2OEUVUP")


def test_crc16_seeds():
    from base64 import b32encode
    from binascii import crc_hqx

    raw = bytes([18 << 3]) + bytes(range(32))
    seed = b32encode(raw + crc_hqx(raw, 0).to_bytes(2, "little")).decode()
    assert [k for *_, k in secrets.find_spans(f"stellar {seed}")] == ["stellar"]
    assert secrets.find_spans(f"stellar {seed[:-1]}{'A' if seed[-1] != 'A' else 'B'}") == []


def test_secret_query(spark, sf):
    got = {r.doc_id: r for r in queries.queries()["op12_secret_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base, r = base_by_hand(text or ""), got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in base) for x in secrets.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert set(r.spans.split(",")) >= {f"{k}:{a}:{b}" for a, b, k in base}


def test_secret_scan_odd_rows(spark):
    long = "x " * 300_000 + "token=abcdef123 " + "a" * 200_000
    rows = [(1, None), (1, ""), (None, "token: 'abcdef1'"), (2, long), (2, long)]
    df = spark.createDataFrame([(k, t, "k", 1) for k, t in rows], "doc_id long, text string, kind string, start int")
    found = sorted(map(tuple, secrets.scan_secrets(df).collect()), key=str)
    assert found == sorted([(2, "assign", 600_000, 600_015), (2, "hex", 600_016, 800_016)] * 2 + [(None, "assign", 0, 15)], key=str)
    hidden = secrets.redact_secrets(df).collect()
    assert [r.text for r in hidden][:3] == [None, "", "<secret>'"] and hidden[3].text.endswith(" <secret> <secret>") and set(hidden[0].asDict()) == set(df.columns)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


# 13 -----------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(made[c]) == len(node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids(node), sum(not kids(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng):
    texts, rows = ["hi", "Hi", "", None, "é漢😀", "x" * 300], []
    for c in [*range(0, 40), 100, 102, 104, 999_983]:
        if c % 10 == 5:
            continue  # families without their first
        rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.choice([1, 2, 6])])) for t in range(rng.choice([1, 2, 3, 7, 8, 12]))]
    rows += [(50, t, "user", "hi") for t in range(90)] + [(53, t, "user", "hi") for t in range(70)] + [(54, t, "user", "hi" if t < 60 else "no") for t in range(90)]
    rows += [(None, 1, "user", "hi")] * 3
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_trie_against_brute_force(spark, monkeypatch, weak):
    from pyspark.sql import functions as F

    if weak:  # names and fingerprints that collide all the time
        monkeypatch.setattr(prefixtrie, "turn_name", lambda: F.length("text") % 2)
        monkeypatch.setattr(prefixtrie, "PRIMES", (3, 2))
        monkeypatch.setattr(prefixtrie, "BASES", (2, 1))
    rows = conversations(random.Random(5))
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], "conv_id long, turn long, role string, text string, c int, d int, g string")
    got = prefixtrie.prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)
    if not weak:
        assert prefixtrie.prefix_trie(df.limit(0)).count() == 0 == prefixtrie.prefix_trie(df.filter("conv_id IS NULL")).count()


def test_trie_of_a_long_chain_of_branches(spark):
    """Each conversation leaves the one before it a turn later, so the chains hang on each other."""
    rows = [(5 * c, t, "user", "a" if t < c else f"b{c}") for c in range(20) for t in range(c + 2)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)


def test_running_sums_cross_ranges(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(-5, 1000)) for k, n in ((1, 5000), (2, 1), (3, 4000), (9, 3)) for i in range(n)]
    p, b = 97, 5
    got = prefixtrie.running(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], [("v", "plain", 1, None), ("v", "poly", b, p)]).collect()
    total, poly, place = Counter(), Counter(), Counter()
    want = {}
    for k, i, v in sorted(rows):
        before = total[k], poly[k]
        total[k], poly[k] = total[k] + v, (poly[k] + v * pow(b, place[k], p)) % p
        want[k, i] = (place[k], total[k], before[0], poly[k], before[1])
        place[k] += 1
    assert {(r.k, r.i): (r.place, r.plain, r.plain_, r.poly, r.poly_) for r in got} == want
