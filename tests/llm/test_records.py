"""Pieces, URL lists, tool calls and the pipeline."""

import datetime as dt
import json
import os
import random
from collections import defaultdict

import pytest

from tideline.llm import pieces, queries, tool_calls, url_filters

MODEL = queries.TOKENIZER
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file here")
ODD = ["", " ", "  a  ", "Hello  world", "a\tb\nc", "ﬁ Ａ　é é 🙂", "<s> </s> <unk>", "日本語 ≠ ∑", "x" * 300, "!!!!==--", "a\x00b", "\xa0a", "thbleouing. don't 1234"]


@needs_model
def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeé .,'\n1▁") for _ in range(rng.randrange(200))) for _ in range(200)] + [" ".join(["word"] * 30_000)]
    rows = [(i, t, "1") for i, t in enumerate(texts)] + [(None, None, "2"), (3, "same", "3"), (3, "same", "3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t string")
    out = pieces.encode(df, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in out:
        assert r.ids == (None if r.text is None else library.encode(r.text))
    back = pieces.decode(pieces.encode(df, MODEL).drop("text"), MODEL).collect()
    assert [r.text for r in back] == [None if r.ids is None else library.decode(r.ids) for r in out]
    exact = {r.doc_id: r.exact for r in pieces.round_trip(df, MODEL).collect()}
    assert all(exact[i] for i, t in enumerate(texts) if "▁" not in t)
    assert pieces.encode(df.where("false"), MODEL).count() == 0


@needs_model
def test_malformed_byte_pieces_decode_like_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    fst = pieces.Transducer(pieces.Model(MODEL))
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(12)]
        assert fst.decode(ids) == library.decode(ids)


def stamp(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_url_lists_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "evil.net"]
    entries = []
    for _ in range(300):
        kind = rng.choice(["d:", "p:", "u:"])
        pattern = kind + rng.choice(hosts) + ("" if kind == "d:" else rng.choice(["/p", "/p/q", "/p/q/r"]))
        entries.append((rng.choice("lmn"), rng.choice(["allow", "block"]), pattern, stamp(rng.randrange(900)), rng.choice(["add", "add", "remove"])))
    entries += entries[:20] + [(None, "block", "d:x.org", stamp(1), "add"), ("l", "block", None, stamp(1), "add"), ("l", "block", "d:x.org", None, "add"), ("l", "deny", "d:x.org", stamp(0), "add")]
    pages = [(i, f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/', '/P/q/r?x=1#y', '/p/q/r'])}", stamp(rng.randrange(950), rng.randrange(24)), "z") for i in range(400)]
    pages += [(None, pages[0][1], pages[0][2], "z"), (5, *pages[5][1:]), (900, None, stamp(1), "z"), (901, "nohost", stamp(1), "z"), (902, "", stamp(1), "z"), (903, pages[1][1], None, "z"), (904, "HTTP://u:p@EVIL.net:8080/p", stamp(400), "z"), (905, "https://x.org/" + "p" * 50_000, stamp(3), "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, fetched_at timestamp_ntz, pattern string")
    lists = spark.createDataFrame(entries, "list string, verdict string, pattern string, at timestamp_ntz, action string")
    got = {(r.page_id, r.fetched_at): (r.allowed, r.verdict, r.list, r.pattern, r.valid_from, r.n_active) for r in url_filters.judge(df, lists).collect()}
    moments = {}
    for name, verdict, pattern, at, action in entries:
        if name and pattern and at and verdict in ("allow", "block"):
            had = moments.get((name, pattern, at))
            moments[name, pattern, at] = (max(action, had[0]), min(verdict, had[1])) if had else (action, verdict)
    history = defaultdict(list)
    for (name, pattern, at), (action, verdict) in sorted(moments.items()):
        history[name, pattern].append((at, action, verdict))
    for i, url, at, _ in pages:
        keys, found = set(), []
        if url and "://" in url:
            rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
            netloc, _, path = rest.partition("/")
            host = netloc.lower().rpartition("@")[2].split(":")[0]
            full = (host + "/" + path if path else host).rstrip("/")
            labels, parts = host.split("."), full.split("/")
            keys = {"d:" + ".".join(labels[k:]) for k in range(max(len(labels) - 1, 1))} | {"p:" + "/".join(parts[: k + 1]) for k in range(1, len(parts))} | {"u:" + full}
        for (name, pattern), log in history.items():
            if pattern in keys and at is not None and (past := [x for x in log if x[0] <= at]) and past[-1][1] == "add":
                found.append((-len(pattern), past[-1][2], name, pattern, past[-1][0]))
        best = min(found, default=None)
        want = (True, None, None, None, None, 0) if best is None else (best[1] != "block", best[1], best[2], best[3], best[4], len(found))
        assert got[i, at] == want, (i, url)
    assert url_filters.judge(df, lists).count() == len(pages)
    assert url_filters.judge(df, lists.where("false")).where("not allowed").count() == 0
    assert url_filters.judge(df.where("false"), lists).count() == 0


def brute_depth(calls):
    """(conv, call) -> (depth, peak) along the calls waited for, None on a cycle."""
    out = {}
    for key in calls:
        seen, depth, at, peak = {key}, 0, key, calls[key][0]
        while (up := (at[0], calls[at][1])) in calls:
            if up in seen:
                depth = None
                break
            seen.add(up)
            depth, at, peak = depth + 1, up, max(peak, calls[up][0])
        out[key] = (depth, peak)
    return out


def test_tool_calls_are_linked_ordered_and_checked(spark):
    rng = random.Random(4)
    rows, calls = [], {}
    for conv in range(6):
        for turn in range(60 if conv else 300):
            after = f"c{rng.randrange(60)}" if rng.random() < 0.3 else f"c{turn - 1}" if turn and conv == 0 else None
            args = rng.choice(['{"page": %d}' % turn, '{"page": -1}', '{"page": 1, "mode": "pdf"}', "{broken", None, '{"page": 1, "q": NaN}', '{"z":1,"page":2}'])
            rows.append((conv, turn, "assistant", f"t{turn}", f"c{turn}", "fetch" if turn % 5 else "shell", args, after, None))
            calls[conv, f"c{turn}"] = (turn, after)
            if turn % 3:
                rows.append((conv, turn + 1, "tool", f"r{turn}", None, None, None, None, f"c{turn}"))
    rows += [(1, 999, "tool", "late", None, None, None, None, "c1"), (1, 5, "tool", None, None, None, None, None, "nobody"), (None, 1, "assistant", "x", "c1", "fetch", "{}", None, None), (7, None, None, None, None, None, None, None, None), (8, 1, "user", "word " * 50_000, None, None, None, None, None)]
    rows += [(9, 1, "user", "twice", None, None, None, None, None)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv bigint, turn bigint, role string, text string, call string, tool string, arguments string, after string, result_of string, status string")
    out = tool_calls.link(df, queries.SCHEMAS).collect()
    assert len(out) == len(rows)
    depth = brute_depth(calls)
    place = {}
    for r in out:
        body = json.loads(r.json)
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r.kind == "call" and r.conv is not None:
            want = depth[r.conv, r.call][0]
            assert r.depth == want and (r.status == "cycle") == (want is None)
            if want is not None:
                place[r.conv, r.call, "call"] = r.place
                turn = calls[r.conv, r.call][0]
                args = next(x[6] for x in rows if x[0] == r.conv and x[4] == r.call)
                if turn % 5 == 0:
                    assert r.status == "unknown tool"
                elif args in (None, "{broken") or "NaN" in args:
                    assert r.status == "arguments are not JSON"
                elif "-1" in args or "pdf" in args or "z" in args:
                    assert r.status.startswith("$")
                else:
                    assert r.status == ("ok" if turn % 3 else "no result")
        if r.kind == "result" and r.status == "ok" and r.depth is not None:
            place[r.conv, r.call, "result"] = r.place
    for (conv, call), (_, after) in calls.items():
        mine, first = place.get((conv, call, "call")), place.get((conv, after, "call"))
        if mine and first and (conv, after) in calls:
            assert first < mine
        if mine and (conv, call, "result") in place:
            assert mine < place[conv, call, "result"]
    status = {r.json: r.status for r in out if r.conv == 1 and r.kind == "result" and r.turn in (5, 999)}
    assert "orphan" in status.values() and "repeated" in status.values()
    assert tool_calls.link(df.where("false"), queries.SCHEMAS).count() == 0


def test_schema_violations():
    s = queries.SCHEMAS
    assert tool_calls.check_arguments("search", '{"limit": 5, "query": "é"}', s) == ('{"limit":5,"query":"é"}', "ok")
    assert "$.limit: missing" in tool_calls.check_arguments("search", '{"query": ""}', s)[1]
    assert tool_calls.check_arguments("search", '{"query": "a", "limit": true}', s)[1] == "$.limit: not integer"
    assert tool_calls.check_arguments("note", '{"words": ["ab", "c"]}', s)[1] == "$.words[1]: too short"
    assert tool_calls.check_arguments("search", '{"query": "a", "limit": 1, "x": 1}', s)[1] == "$.x: unknown"
    assert tool_calls.check_arguments("search", "[1]", s)[1] == "$: not object"


@needs_model
def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda n: "\n".join(" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}w{rng.randrange(5000)}" for _ in range(12)) for _ in range(n))
    passage = text(10)
    copied = text(8).replace("\n", " ")
    rows = [(i, text(8), "en", "s0" if i % 3 else "s1") for i in range(60)]
    rows += [(61, copied, "en", "s0"), (100, copied + " more", "en", "s0"), (106, rows[4][1], "en", "s0"), (101, text(4) + "\n" + passage, "en", "s1"), (102, text(4) + "\n" + passage, "en", "s1"), (103, "a$$$ b%%% " * 40, "en", "s0"), (104, None, None, None), (105, "", "en", "s0")]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = str(tmp_path)
    df.write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == df.columns, name
    out = corpus_pipeline.run(spark, path)
    kept = {r.doc_id for r in out.collect()}
    assert set(range(60)) | {61, 101, 102} <= kept and not kept & {100, 103, 104, 105, 106}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    originals = {i: t for i, t, _, _ in rows}
    for r in out.collect():
        if r.doc_id < 60:
            assert r.ids == library.encode(originals[r.doc_id]) and r.n_ids == len(r.ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]


def test_near_duplicates_keep_one_row_of_each_class(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    # repeated rows; an id with a near copy and a clean text; the smallest id of a class has a second text that is a near copy; null ids only; null ids beside an id
    rows = [(1, a), (1, a), (1, a), (10, b), (11, b + " more"), (11, c), (20, d), (21, d + " tail"), (20, b + " end")]
    rows += [(None, e), (None, e), (None, e + " x"), (None, f), (30, f + " y"), (None, ""), (None, ""), (40, " "), (40, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    some = [x for x in got if x[1].startswith(e)]
    assert len(some) == 1
    assert sorted(map(str, (x for x in got if x not in some))) == sorted(map(str, [(1, a), (10, b), (11, c), (20, d), (30, f + " y"), (None, ""), (None, ""), (40, " ")]))


def test_deep_path_entries_match(spark):
    at = dt.datetime(2024, 1, 2)
    pages = [(i, u, at) for i, u in enumerate(["https://x.org/a/b/c", "https://x.org/a/b/c/d/e?q#f", "https://x.org/a/b", "https://x.org/a/b/cc", "https://x.org/a/b/c/d/e/f/g/h"])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, fetched_at timestamp_ntz")
    schema = "list string, verdict string, pattern string, at timestamp_ntz, action string"
    entry = lambda pattern, verdict="block": ("l", verdict, pattern, dt.datetime(2024, 1, 1), "add")
    lists = spark.createDataFrame([entry("p:x.org/a/b/c"), entry("p:x.org/a/b/c/d/e/f/g", "allow")], schema)
    got = {r.page_id: (r.allowed, r.n_active) for r in url_filters.judge(df, lists, folders=None).collect()}
    assert got == {0: (False, 1), 1: (False, 1), 2: (True, 0), 3: (True, 0), 4: (True, 2)}
    flat = spark.createDataFrame([entry("d:x.org"), entry("u:x.org/a/b")], schema)
    assert {r.page_id: r.n_active for r in url_filters.judge(df, flat, folders=None).collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1}


def test_derived_arguments_hold_whole_words(spark, tmp_path):
    word = "w" * 600
    spark.createDataFrame([(1, 0, "assistant", word), (1, 1, "user", "x y")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.messages(spark, str(tmp_path)).where("role = 'assistant'").first()
    assert json.loads(out.arguments)["query"] == word


def test_arguments_without_a_text_form_and_json_types():
    s = queries.SCHEMAS
    for bad in ('{"query":"\\ud83d","limit":3}', '{"\\ud800":1}', "[" * 100_000):
        assert tool_calls.check_arguments("search", bad, s) == (None, "arguments are not JSON")
    assert tool_calls.check_arguments("search", '{"query":"\\ud83d\\ude00","limit":3.0}', s)[1] == "ok"
    either = {"t": {"type": ["integer", "null"], "enum": [1, None]}}
    assert [tool_calls.check_arguments("t", x, either)[1] for x in ("1", "1.0", "null", "true", '"a"')] == ["ok", "ok", "ok", "$: not integer or null", "$: not integer or null"]
    deep = {"t": {"enum": [{"a": [1, False]}]}}
    assert [tool_calls.check_arguments("t", x, deep)[1] for x in ('{"a":[1.0,false]}', '{"a":[1,0]}', '{"a":[true,false]}')] == ["ok", "$: not in enum", "$: not in enum"]


def test_calls_that_wait_for_several_are_ordered(spark):
    rng = random.Random(9)
    waits = {}
    for conv in range(30):
        n = rng.randrange(1, 40)
        for i in range(n):
            pool = range(i) if conv % 3 else range(n)  # every third conversation has circles
            waits[conv, f"c{i}"] = sorted({f"c{rng.choice(pool)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} | ({"gone"} if rng.random() < 0.1 else set())) if pool else []
    diamond = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c", "c"], "e": ["d"], "f": ["e", "a"], "x": ["y"], "y": ["x"], "z": ["x", "a"]}
    waits |= {(99, k): v for k, v in diamond.items()}
    rows = [(conv, i, "assistant", "t", call, "fetch", '{"page":1}', after, None) for i, ((conv, call), after) in enumerate(waits.items())]
    rng.shuffle(rows)
    schema = "conv bigint, turn bigint, role string, text string, call string, tool string, arguments string, after array<string>, result_of string"
    out = {(r.conv, r.call): r for r in tool_calls.link(spark.createDataFrame(rows, schema), queries.SCHEMAS).collect()}

    def depth(conv, call, path=()):
        if call in path:
            return None
        before = [depth(conv, c, (*path, call)) for c in set(waits[conv, call]) if (conv, c) in waits]
        return None if None in before else max((d + 1 for d in before), default=0)

    for (conv, call), after in waits.items():
        want = depth(conv, call)
        assert out[conv, call].depth == want, (conv, call)
        for c in after:
            if want is not None and (conv, c) in waits:
                assert out[conv, c].place < out[conv, call].place
    assert [out[99, c].depth for c in "abcdefxyz"] == [0, 1, 1, 2, 3, 4, None, None, None]
    assert json.loads(out[99, "d"].json)["tool_call"]["after"] == ["b", "c", "c"] and json.loads(out[99, "b"].json)["tool_call"]["after"] == "a"


def test_unigram_paths_are_the_library_s(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng = random.Random(12)
    m = proto.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    texts = {"▁", *"abcdé"} | {"".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 6))) for _ in range(120)}
    texts |= {"▁" + "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(60)}
    for piece in sorted(texts):
        m.pieces.add(piece=piece, score=-rng.uniform(1, 12), type=1)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(pieces.Model(path))
    assert fst.model.kind == "unigram"
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 6)))
        ids = [int.from_bytes(fst.encode(text)[k : k + 4], "little") for k in range(0, len(fst.encode(text)), 4)]
        assert ids == library.encode(text) and fst.decode(ids) == text
