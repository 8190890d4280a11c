"""Operators on documents against brute force and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import chosen_path, hash_index, line_chunks, mixing, noisy_channel, rank_profiles, rule_cascade, tables

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
#: Names that the operators use inside, as columns of the input.
CLASH = {"h": "1", "t": "2", "key": "3", "id": "4", "score": "5", "block": "6", "_id": "7", "r": "8", "gone": "9"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *CLASH.values()) for i, t, s in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"v{rng.randrange(words)}" for _ in range(n))


def awkward(rng):
    base = prose(rng, 60)
    return [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"), (None, base, "a"), (None, base, "a"), (6, LONG, "c"), (7, LONG.upper(), "c"), (8, base + " tail", "a")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rules_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [r[1] for r in awkward(rng)] + ["a b c d e " * 5, "x\ny\nx\n \n \nx", "é# ö* z\x0b<q>|&%$", "THE!! CAT!! " * 30, "\n".join(["same line here"] * 40)]
    texts += [prose(rng, rng.randrange(1, 80), 6) for _ in range(60)]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: r for r in rule_cascade.apply_rules(df, measures=base).collect()}
    for i, text in enumerate(texts):
        t, w = text or "", words_of(text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        full = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        assert tuple(got[i][c] for c in base) == want, i


def test_rules_order_does_not_change_the_verdict(spark):
    rng = random.Random(2)
    df = frame(spark, awkward(rng) + [(100 + i, "a$$$ b%%% " * i, "s") for i in range(12)])
    planned = rule_cascade.plan(df)
    assert {r.name for r in planned} == {r.name for r in rule_cascade.RULES}
    one = sorted(map(str, rule_cascade.apply_rules(df, order=planned).select("doc_id", "passed").collect()))
    two = sorted(map(str, rule_cascade.apply_rules(df, order=planned[::-1]).select("doc_id", "passed").collect()))
    assert one == two
    kept = rule_cascade.passing(df)
    assert kept.columns == df.columns and kept.count() == sum("passed=True" in x for x in one)
    assert rule_cascade.apply_rules(df.limit(0)).count() == 0 and rule_cascade.passing(df.where("false")).count() == 0


def test_exact_dedup_on_awkward_rows_and_collisions(spark):
    rng = random.Random(3)
    rows = awkward(rng) + [(20 + i, f"Text {i % 7}", "s") for i in range(40)]
    df = frame(spark, rows)
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    for key in (None, F.length("t").cast("bigint") % 3, F.lit(5).cast("bigint")):
        got = [tuple(r) for r in hash_index.deduplicate(df, capacity=4, max_depth=6, key=key).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert hash_index.deduplicate(df.where("false")).count() == 0


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    found = hash_index.directory(keys, capacity=200, max_depth=12)
    assert sum(b[2] for b in found) == 4000 and max(b[2] for b in found) <= 200 and len(found) > 20
    assert sum(2.0 ** -b[0] for b in found) == 1.0


def brute_classes(rows, threshold=0.8):
    sets = []
    for i, t, _ in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return [(rows[a][0], least.get(find(a)), links[a]) for a in range(len(rows))]


@pytest.mark.parametrize("small,block", [(48, 192), (4, 5)])
def test_similarity_join_matches_brute_force(spark, small, block):
    rng = random.Random(4)
    rows = awkward(rng)
    base = [prose(rng, 120, 3000) for _ in range(6)]
    for n in range(90):
        w = base[n % 6].split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + n, " ".join(w), "s"))
    rows += [(2000 + n, prose(rng, 50, 3000), "s") for n in range(40)]
    got = [(r.doc_id, r.class_id, r.n_links) for r in chosen_path.similar(frame(spark, rows), small=small, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_classes(rows)))


def linked(spark, edges):
    """(node, root) by ``components``, the tasks it took with 60 shuffle partitions that are not merged, and the roots by union."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    own = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    context, group = spark.sparkContext, f"links-{random.random()}"
    context.setJobGroup(group, "components")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in chosen_path.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    status = context.statusTracker()
    stages = {i for j in status.getJobIdsForGroup(group) for i in status.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)
    return got, tasks, sorted((x, find(x)) for a, b in edges if a != b for x in {a, b})


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],
    [(500, i) for i in range(300)] + [(7, 7), (9, 500)],
    [(900 - i, 900 - i // 2) for i in range(1, 200)] + [(1, 2), (2, 1), (2, 1)],
    [(2000, 2000)],
])
def test_components_are_those_of_a_union(spark, edges):
    got, tasks, want = linked(spark, edges)
    assert got == sorted(set(want))


def test_components_of_few_links_take_few_tasks(spark):
    got, tasks, want = linked(spark, [(i, i // 3) for i in range(1, 300)])
    assert got == sorted(set(want))
    # one exchange of the links cleared of repeats and a few tasks a round, however many shuffle partitions there are
    assert tasks < 1000


def test_narrow_tables_are_written_by_as_many_tasks_as_their_rows_ask(spark):
    rows = spark.range(0, 1000, 1, 40).repartition(40)
    for said, files in ((1000, 1), (3 * tables.TASK_ROWS, 3), (10**9, 40)):
        out = tables.stored(rows, "few", said)
        assert (len(out.inputFiles()), out.count()) == (files, 1000)


def test_similarity_join_of_nothing(spark):
    assert chosen_path.similar(frame(spark, [(1, None, "a")]).where("false")).count() == 0
    assert [tuple(r) for r in chosen_path.similar(frame(spark, [(1, " ", "a")])).collect()] == [(1, 1, 0, 0, 0)]


def test_line_chunks_match_brute_force(spark):
    rng = random.Random(5)
    line = lambda: prose(rng, rng.randrange(3, 12))
    passages = [[line() for _ in range(9)] for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(rng.randrange(1, 12))]
        if i % 2:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passages[i % 3]
        rows.append((i, "\n".join(lines), "s"))
    rows += [(None, rows[1][1], "s"), (70, rows[3][1], "s"), (70, rows[3][1], "s"), (71, None, "s"), (72, "", "s"), (73, "\n".join([LONG] * 3), "s"), (74, "\n".join([LONG] * 3), "s")]
    df = frame(spark, rows)
    docs = line_chunks.documents(df, "doc_id", "text")
    number = {(r.id, None if r.lines is None else "\n".join(r.lines)): r.k for r in docs.collect()}
    found = line_chunks.bodies(docs, line_chunks.occurrences(docs)).distinct().collect()
    place = lambda r: (r.id is None, r.id or 0, r.k, r.a)
    first, count = {}, Counter()
    for r in found:
        count[r.body] += 1
        first[r.body] = min(first.get(r.body, place(r)), place(r))
    gone = defaultdict(set)
    for r in found:
        if count[r.body] > 1 and place(r) != first[r.body]:
            gone[r.k].update(range(r.a, r.b))
    out = line_chunks.deduplicate_lines(df, size_col="n_chars")
    assert out.columns == df.columns
    want = []
    for i, t, _ in rows:
        mine = gone.get(number[i, t], ())
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in mine)))
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    # passages go from all but one document, other lines stay
    holders = [sum(1 for i, t in want if i is not None and t and p[4] in t) for p in passages]
    assert max(holders) <= 3
    own = {x for i, t, _ in rows[:60] for x in t.split("\n")} - {x for p in passages for x in p}
    left = {x for i, t in want if t for x in t.split("\n")}
    assert own <= left
    assert line_chunks.deduplicate_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("budget", ["sum", "cover"])
def test_mixing_meets_weights_and_quotas(spark, budget):
    rng = random.Random(6)
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randrange(5, 40)), "big" if i % 3 else rng.choice("defg")) for i in range(600)]
    df = frame(spark, rows)
    got = mixing.mix(df, target_entropy=0.9, max_repetition=3.0, budget=budget, blocks=16).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.tokens == 0 or budget == "sum" or r.copies >= 1
    for source, rs in by.items():
        used, most = sum(r.tokens * r.copies for r in rs), max(r.tokens for r in rs)
        if most:
            assert rs[0].quota - most < used <= rs[0].quota, source
            assert max(r.copies for r in rs) <= 4
    weights = {s: rs[0].weight for s, rs in by.items()}
    assert abs(sum(weights.values()) - 1) < 1e-4
    out = mixing.mixed(df, target_entropy=0.9, max_repetition=3.0, budget=budget, blocks=16)
    assert out.columns == df.columns
    used = Counter(r.doc_id for r in out.collect())
    assert all(used[r.doc_id] == r.copies for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_rank_profiles_match_brute_force(spark):
    rng = random.Random(7)
    alphabet = {"xx": "abcdef", "yy": "fghijk", "zz": "éàøabz"}
    make = lambda k: " ".join("".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 60)))
    rows = [(i, make(k), k) for i in range(120) for k in [rng.choice(list(alphabet))]]
    df = spark.createDataFrame([(i, t, k, "9") for i, t, k in rows], "doc_id bigint, text string, lang string, distance string")
    learned = rank_profiles.profiles(df, where=F.col("doc_id") % 2 == 0, top=80)
    got = {r.doc_id: r for r in rank_profiles.identify(df, learned, top=80).collect()}

    def counted(t):
        import numpy as np

        raw = np.frombuffer(t.encode(), np.uint8)
        return Counter(rank_profiles.grams(raw, np.array([0, len(raw)]))[1].tolist())

    totals = defaultdict(Counter)
    for i, t, k in rows:
        if i % 2 == 0:
            totals[k].update(counted(t))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:80]]
    profile = {k: {g: n for n, g in enumerate(order(c))} for k, c in totals.items()}
    for i, t, k in rows:
        own = order(counted(t))
        dist = {name: sum(abs(p[g] - n) if g in p else 80 for n, g in enumerate(own)) for name, p in profile.items()}
        best = min(sorted(dist), key=dist.get)
        assert (got[i].lang_pred, got[i].distance) == (best, dist[best])
    assert sum(got[i].lang_pred == k for i, t, k in rows if i % 2) > 50
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?\n"), (None, "éàø àø"), (None, "éàø àø"), (5, LONG)], "doc_id bigint, text string")
    out = [(r.doc_id, r.lang_pred, r.score) for r in rank_profiles.identify(odd, learned, top=80).collect()]
    assert [x[1:] for x in out if x[0] in (1, 2, 3)] == [("und", 0.0)] * 3 and all(0 <= x[2] <= 1 for x in out)
    assert out[3] == out[4] and out[3][1] == "zz"
    assert rank_profiles.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert rank_profiles.profiles(df.where("false")) == {}


def test_viterbi_is_the_best_of_all_paths():
    counts = Counter()
    for w in ["idiot"] * 9 + ["moron"] * 5 + ["loser"] * 5 + ["the", "dot", "in", "on"] * 20:
        s = f"^^{w}$"
        counts.update(s[k : k + 3] for k in range(len(s) - 2))
    model = noisy_channel.CharModel.of(dict(counts))

    def every(steps):
        if not steps:
            yield "", 0.0
            return
        for out, cost in steps[0]:
            for rest, more in every(steps[1:]):
                yield out + rest, cost + more

    def price(word, channel):
        s = f"^^{word}$"
        return channel + sum(model.cost(*s[k : k + 3]) for k in range(len(s) - 2))

    for token, want in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("id!ot", "idiot")]:
        best = min(every(noisy_channel.lattice(token)), key=lambda x: price(*x))
        assert noisy_channel.decode(token, model) == best[0] == want
    assert noisy_channel.restored_text("The 1D10T\nm 0 r 0 n", model) == "the idiot\nmoron"


def test_toxicity_restores_hidden_words_and_survives_awkward_rows(spark):
    rng = random.Random(8)
    bad, rows, labels = ["idiot", "moron"], [], []
    for i in range(400):
        w = prose(rng, 40).replace("v", "").split()
        w = ["".join(chr(97 + int(c)) for c in x) for x in w]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "1", "2") for i, t in rows], "doc_id bigint, text string, score string, y string")
    marks = spark.createDataFrame(labels + [(None, 1), (900, None), (901, 7)], "doc_id bigint, toxic int")
    chars = noisy_channel.learn_chars(docs)
    evidence = noisy_channel.learn_evidence(docs, marks, chars)
    assert {"idiot", "moron"} <= set(evidence)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "abc cab"), (4, "you 1d10t"), (5, "m o r o n here"), (6, "idiiiot!!!"), (None, "moron"), (None, "moron"), (8, LONG), (9, "\x00 ퟿ 12345 $$$ ...")], "doc_id bigint, text string")
    got = [(r.doc_id, r.score) for r in noisy_channel.score(odd, chars, evidence).collect()]
    assert all(0 <= s <= 1 for _, s in got)
    assert [s >= 0.7 for _, s in got] == [False, False, False, True, True, True, True, True, False, False]
    assert noisy_channel.score(odd.where("false"), chars, evidence).count() == 0
    assert noisy_channel.learn_evidence(docs, marks.where("false"), chars) == {}
    assert noisy_channel.learn_chars(docs.where("false")).counts == {}
    assert noisy_channel.restored(odd, chars).where("doc_id = 4").first().restored == "you idiot"


def test_every_repeated_run_of_two_lines_goes_whole(spark):
    rng = random.Random(9)
    fresh = iter(range(10**6))
    line = lambda: f"line {next(fresh)}"
    rows = []
    for n in range(60):
        # a passage of two to six lines in the middle of two documents, at different depths
        passage = [line() for _ in range(2 + n % 5)]
        for i in (2 * n, 2 * n + 1):
            rows.append((i, "\n".join([*(line() for _ in range(rng.randrange(1, 6))), *passage, *(line() for _ in range(rng.randrange(1, 6)))]), "s"))
    # pieces of one passage in several documents, a run inside one document, runs of equal lines, a lone repeated line
    rows += [(200, "a\nb\nc\nd", "s"), (201, "x1\nb\nc\nx2\na\nb", "s"), (202, "c\nd\nx3\nb\nx4", "s"), (203, "p\nq\ny1\np\nq\ny2", "s")]
    rows += [(210, "e\ne\ne", "s"), (211, "z1\ne\ne\ne", "s"), (212, "f\nf\nf\nf", "s"), (213, "g\ng", "s"), (214, "g\ng\ng\nh", "s")]
    rows += [(220, "0\n" * 4000 + "m\nn", "s")]
    got = {r.doc_id: r.text for r in line_chunks.deduplicate_lines(frame(spark, rows)).collect()}
    # maximal repeated runs, found without chunks: a line goes if it lies in two lines that stand earlier
    for i, t, _ in rows[:120]:
        seen = {pair for j, u, _ in rows[:120] if j < i for w in [u.split("\n")] for pair in zip(w, w[1:])}
        w = t.split("\n")
        gone = {x for k, pair in enumerate(zip(w, w[1:])) if pair in seen for x in (k, k + 1)}
        assert len(gone) == (2 + (i // 2) % 5 if i % 2 else 0)
        assert got[i] == "\n".join(x for k, x in enumerate(w) if k not in gone)
    want = {200: "a\nb\nc\nd", 201: "x1\nx2", 202: "x3\nb\nx4", 203: "p\nq\ny1\ny2", 210: "e\ne\ne", 211: "z1", 212: "f\nf", 213: "g\ng", 214: "g\nh", 220: "0\n0\nm\nn"}
    assert {i: got[i] for i in want} == want


def test_toxic_words_of_the_tail_are_learned_from_copied_rows(spark):
    rng = random.Random(10)
    tail = ["idiot", "moron", "loser", "clown"]
    say = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda extra: " ".join([*(say() for _ in range(30)), extra, say()])
    # 48 distinct toxic texts of 40 rows each, every word in 12 of them; clean near copies of some, and clean texts
    bad = [text(tail[i % 4]) for i in range(48)]
    rows = [(t, 1) for t in bad for _ in range(40)] + [(t.rsplit(" ", 2)[0] + " fine " + say(), 0) for t in bad[:24]] + [(text(say()), 0) for _ in range(2000)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    evidence = noisy_channel.learn_evidence(docs, marks, noisy_channel.learn_chars(docs))
    assert set(tail) <= set(evidence) and "fine" not in evidence


def test_vocabularies_of_falling_size_and_two_scripts_are_found_on_held_out_rows(spark):
    rng = random.Random(11)
    bad = {"abcdefgh": (["idiot", "moron"], 60), "klmnopqr": (["trottel", "depp"], 25), "stuvwxyz": (["tonto", "bobo"], 11), "абвгдежз": (["дурак", "болван"], 5)}
    rows = []
    for letters, (words, n) in bad.items():
        say = lambda letters=letters: "".join(rng.choice(letters) for _ in range(6))
        text = lambda extra, say=say: " ".join([*(say() for _ in range(25)), *extra, say()])
        rows += [(text(words), 1, True) for _ in range(n)] + [(text([]), 0, True) for _ in range(600)]
        # held out: plain words, and hidden ones of either script
        hidden = [w[0] + " " + " ".join(w[1:]) for w in words]
        rows += [(text(words), 1, False) for _ in range(6)] + [(text([hidden[0], say(), hidden[1]]), 1, False), (text([w.replace("o", "0").replace("а", "@") for w in words]), 1, False)] + [(text([]), 0, False) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, known) for i, (t, _, known) in enumerate(rows)], "doc_id bigint, text string, known boolean")
    marks = spark.createDataFrame([(i, y) for i, (_, y, known) in enumerate(rows) if known], "doc_id bigint, toxic int")
    chars = noisy_channel.learn_chars(docs.where("known"))
    assert any(g > "а" for g in chars.counts)
    evidence = noisy_channel.learn_evidence(docs.where("known"), marks, chars)
    scores = {r.doc_id: r.score for r in noisy_channel.score(docs.where("not known"), chars, evidence).collect()}
    missed = [rows[i][0][-40:] for i, p in scores.items() if rows[i][1] and p < 0.7 and "@" not in rows[i][0]]
    assert missed == [] and all(p < 0.7 for i, p in scores.items() if not rows[i][1])


def test_long_documents_lose_lines_in_time_in_proportion(spark):
    import time

    line = [f"shared {i}" for i in range(200_000)]
    df = frame(spark, [(1, "\n".join(line), "s"), (2, "own first\n" + "\n".join(line) + "\nown last", "s")])
    start = time.time()
    got = {r.doc_id: r.text for r in line_chunks.deduplicate_lines(df).select("doc_id", "text").collect()}
    assert got[2] == "own first\nown last" and got[1].count("\n") == 199_999
    assert time.time() - start < 60


def test_doubled_letters_are_restored():
    counts = Counter()
    for w in ["idiot"] * 9 + ["moron"] * 5 + ["loser"] * 5 + ["the", "dot", "in", "on"] * 20 + ["letter", "butter"] * 20:
        s = f"^^{w}$"
        counts.update(s[k : k + 3] for k in range(len(s) - 2))
    model = noisy_channel.CharModel.of(dict(counts))
    for token, want in [("iidiot", "idiot"), ("morron", "moron"), ("llooser", "loser"), ("idiott", "idiot"), ("letter", "letter"), ("butter", "butter"), ("dot", "dot")]:
        assert noisy_channel.restore(token, model) == want
