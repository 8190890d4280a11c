"""Operators 11 to 13 against brute force and on awkward rows."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle_manifest, periodic_runs, personal_data

CLASH = {"h": "1", "t": "2", "k": "3", "id": "4", "tree": "5", "pos": "6", "hash": "7", "spans_": "8"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, *CLASH.values()) for i, t, lang, s, n in rows], SCHEMA)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (p, good) in BASE.items() for m in re.finditer(p, text or "") if good(m.group())]


NAMED = [
    "x a@b.c@d.e a@b.c%d@e.f .@-.-.- a@b a@b. @x.y é𝄞ü@a.bc 𝄞 q.w+e@x-y.co.uk,z@z.z", "1.2.3.4.5.6.7.8 999.1.1.1 0.0.0.255 00001.2.3.0000000255 1.2.3 256.1.1.1.1 7.7.7.7",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 4 3 +1 (017) 555-7713 +49-30 123456-7 ++1 2 3 +123456789012345 +1234567890123456 +1 ) 2",
    "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89 3704 0044 0532 0130 01 XX12ABCDEFGHIJKLM xDE89370400440532013000 NO9386011117947 TIINST",
    "my ssn 123-45-6789; 000-12-3456 123-00-4567 1123-45-6789 and order 123-45-6788", "call 0301 234567 or (020) 7946 0958, tel 020.7946.0958; 0301 234567",
]


def test_personal_data_keeps_the_base_and_adds_to_it(spark):
    rng = random.Random(1)
    bits = ["a", "@", ".", "b.c", "1", "22", "255", "256", "-", " ", "+", "(", ")", "%", "é", "𝄞", "\n", "4111111111111111", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 234 567 890", "Z"]
    texts = [None, "", *NAMED, *("".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(250))]
    texts += ["7" * 3_000, "a." * 2_000 + "@", "1." * 3_000, "a@b.c " * 9_000, "+1 " * 20_000, "x" * 9_000]
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = frame(spark, rows)
    found = personal_data.find(df.withColumn("n", F.lit(1)))
    assert found.columns == [*df.columns, "n", "spans"]
    got = [(r.text, [(s.kind, s.start, s.end) for s in r.spans if s.base], [(s.kind, r.text[s.start : s.end]) for s in r.spans if not s.base]) for r in found.collect()]
    more = {}
    for t, base, added in got:
        assert base == base_spans(t), (t or "")[:200]
        more[t] = added
    assert more[NAMED[3]] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("iban", "NO9386011117947")]
    assert more[NAMED[4]] == [("ssn", "123-45-6789")]
    assert more[NAMED[5]] == [("tel", "0301 234567"), ("tel", "(020) 7946 0958"), ("tel", "020.7946.0958")]
    out = {r.doc_id: r for r in personal_data.digest(found.where("doc_id is not null")).collect()}
    for i, t, *_ in rows:
        if i is not None:
            spans = base_spans(t)
            want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in BASE)
    assert personal_data.digest(personal_data.find(df.where("false"))).count() == 0


def test_personal_data_scores_follow_the_words_around(spark):
    df = spark.createDataFrame([(1, "call +1 234 567 8901"), (2, "order +1 234 567 8901"), (3, "+1 234 567 8901")], "doc_id int, text string")
    assert {r.doc_id: r.spans[0].score for r in personal_data.find(df).collect()} == {1: 90, 2: 35, 3: 60}


def test_masking_replaces_accepted_spans(spark):
    df = spark.createDataFrame([("a@b.co, 1.2.3.4! 999.1.1.1; 4111 1111 1111 1111 and +1 234 567 8901.",), (None,), ("IBAN DE89 3704 0044 0532 0130 00 TIINST x",), ("plain",)], "text string")
    assert [r.text for r in personal_data.masked(df).collect()] == ["[EMAIL], [IP]! 999.1.1.1; [CARD] and [PHONE].", None, "IBAN [IBAN] TIINST x", "plain"]


def brute_runs(words, least=24, turns=3):
    """Every period's maximal stretches, smallest period first."""
    out, n = {}, len(words)
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            # a multiple of a smaller period has the same ends
            if j + q - i >= max(least, turns * q) and (i, j + q - i) not in out:
                out[i, j + q - i] = q
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [24, 6])
def test_runs_match_brute_force(spark, least):
    rng = random.Random(2)
    for case in range(500):
        kinds = rng.choice([1, 2, 2, 3, 50])
        words = [rng.randrange(kinds) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            at, q = rng.randrange(len(words) + 1), rng.randrange(1, 14)
            words[at:at] = (([rng.randrange(kinds) for _ in range(q)]) * 9)[: rng.randrange(1, 9 * q + 1)]
        ids = np.array([w + 1 for w in words], np.int64)
        assert periodic_runs.runs(ids, least=least) == brute_runs(words, least), (case, words)


def test_run_digests_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a " * 30, "x\x0by\x1cz " * 40, "é ü " * 50, "one two\nthree " * 9]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += [" ".join(f"w{i}" for i in range(30_000)), "p q r " * 20_000]
    rows = [(None if i % 31 == 7 else i // 2 if i % 5 == 0 else i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = frame(spark, rows)
    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = brute_runs(words) if len(words) < 5000 else [(0, 60_000, 3)] * (words[0] == "p" and len(set(words)) == 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    got = [tuple(r) for r in periodic_runs.digests(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in got) > 10
    detected = periodic_runs.detect(df)
    assert detected.columns == [*df.columns, "runs", "collapsed"]
    assert {r.text: (len(r.runs), r.collapsed) for r in detected.where("text is not null and length(text) < 200").collect()}["a " * 30] == (1, "a")
    assert periodic_runs.digests(df.where("false")).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def climbed(levels, pos, acc):
    seen = []
    for level in levels[:-1]:
        other = pos ^ 1
        pair = [acc] if other >= len(level) else [level[other], acc] if other < pos else [acc, level[other]]
        seen += [level[other]] if other < len(level) else []
        acc, pos = H(*pair), pos // 2
    return seen, acc


def brute_manifest(rows):
    groups = {}
    for r in rows:
        i, text, lang, source, n = r
        leaf = H(*map(field, (i, source, lang, n, text)))
        struck = i is not None and crc32(str(i).encode()) % 7 == 0 and n is not None
        other = H(*map(field, (i, source, lang, n + struck if n is not None else None, text)))
        groups.setdefault("" if lang is None else "=" + lang, []).append((i is not None, i or 0, leaf, other, i))
    names = sorted(groups, key=str.encode)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:4])
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for pos, (_, _, leaf, other, i) in enumerate(groups[g]):
            low, acc = climbed(trees[g], pos, other)
            high, acc = climbed(top, at, acc)
            out.append((i, leaf, trees[g][-1][0], top[-1][0], H(*low, *high), acc, acc == top[-1][0]))
    return out


def proofs(df, width=None):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    altered = merkle_manifest.leaf_hash(*(F.col(c) + struck.cast("int") if c == "n_chars" else F.col(c) for c in fields))
    return merkle_manifest.verify(merkle_manifest.manifest(df, fields, "lang", ["doc_id"], altered=altered, width=width))


@pytest.mark.parametrize("width", [None, 1, 2])
def test_manifest_matches_brute_force(spark, width):
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i, i, i // 3]), rng.choice([None, "", "text " * rng.randrange(9), "é𝄞"]), rng.choice(["en", "en", "en", "en", "é", "", None]), rng.choice(["a", None]), rng.choice([None, i])) for i in range(70)]
    rows += [(500, "alone", "zz", "a", 1), rows[0], rows[0], rows[5]]
    df = frame(spark, rows)
    got = [tuple(r) for r in proofs(df, width).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_and_no_rows(spark):
    one = [(3, "only", "en", "a", 4)]
    assert [tuple(r) for r in proofs(frame(spark, one)).collect()] == brute_manifest(one)
    assert proofs(frame(spark, one).where("false")).count() == 0
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    proofs(frame(spark, one))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
