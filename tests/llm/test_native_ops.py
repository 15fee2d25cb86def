"""URL filters, host quality, mixing and chat formatting against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terracell.llm import chat_format, host_quality, mixing, url_rules

DATA = "/root/testdata/sf0.01"


# URL filters


def test_host_path_and_longest_rule(spark):
    cases = {
        "http://A.example.com/en/x?q#z": ("a.example.com", "/en/x", "example.com/en/"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "x://com": ("com", "", None),
        "x://com/": ("com", "/", "com/"),
        "x://notcom/": ("notcom", "/", None),
        "http://a.net/ES/": ("a.net", "/ES/", None),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/"),
        "http://É.NET?a/es/": ("É.net", "", None),
        "no scheme": ("", "", None),
        "://": ("", "", None),
        "a://b\n/c": ("b\n", "/c", None),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*cases, None])], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.filter_urls(df).collect()}
    assert got == dict(enumerate([*cases.values(), ("", "", None)]))


def brute_rules(rows, min_support, min_confidence):
    """All association rules by counting every token subset."""
    from itertools import combinations

    n, sets, with_label = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), size):
                sets[c] += 1
                with_label[c, label] += 1
    return {(c, y): (k / sets[c], k / n) for (c, y), k in with_label.items() if k / n >= min_support and k / sets[c] >= min_confidence}


def test_mined_rules_and_index(spark):
    rows = [(["a", "b"], "block"), (["a", "b", "c"], "block"), (["a", "c"], "allow"), (["c"], "allow"), (["c", "d"], "allow")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = url_rules.mine(df, 0.1, 0.7)
    want = brute_rules(rows, 0.1, 0.7)
    got = {(tuple(r.tokens), r.label): (pytest.approx(r.confidence), pytest.approx(r.support)) for r in rules.collect()}
    assert got == want
    asked = [["a"], ["a", "b"], ["b", "x"], ["c", "d", "a"], [], ["x"]]
    best = []
    for tokens in asked:
        fit = [(v[0], v[1], -len(c), y) for (c, y), v in want.items() if set(c) <= set(tokens)]
        best.append(max(fit)[3] if fit else None)
    asked_df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, tokens array<string>")
    for limit in (1000, 1):
        got = {r.i: r.mined for r in url_rules.judge_by_rules(asked_df, rules, limit).collect()}
        assert got == dict(enumerate(best)), limit


def test_urls_on_the_table(spark):
    rows = url_rules.filter_urls(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
    fixed = {r.text: r.verdict for r in url_rules.RULES}
    assert all(r.verdict == fixed[r.rule] for r in rows if r.rule)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in url_rules.filter_urls(df).collect()] == ["allow"]
    assert url_rules.filter_urls(df.limit(0)).collect() == []


# Host quality


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + o for p in at.values() if len(p) > 1 for i in p for o in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_features(spark):
    texts = [None, "", " \n ", "a", "a b c d e f g h " * 3, "x " * 40, "é\u00a0ß #$ <>", "l\nl\n\nl ", "one two\x0bthree", ("abc " * 9 + "\n") * 500]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in host_quality.features(df).collect()}
    assert got == {i: plain_features(t) for i, t in enumerate(texts)}


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good if i % 10 else bad, "good") for i in range(100)]
    rows += [(300, good, None), (301, bad, None)] + [(400 + i, bad, "tiny") for i in range(1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_quality.quality(df).collect()}
    assert not any(kept[i] for i in range(100))
    assert all(kept[100 + i] == bool(i % 10) for i in range(100))
    assert kept[300] and not kept[301]
    assert host_quality.quality(df.limit(0)).collect() == []


# Mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 7}") for i in range(3000)]
    rows += [(5000, None, None), (5001, "a b", None), (5002, "x", "a-small"), (5003, "", "empty"), (5004, "q " * 400, "zz"), (5004, "q " * 400, "zz"), (None, "n n", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(mixing.mix(df).collect(), key=repr)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    size, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id, r.size]
        size[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        target[s] = r.target
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size} and (r.size == 0 or len(r.shards) == r.taken // r.size)
    want = plain_targets({s: size[s] for s in size})
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= largest[s] * (2 if s == "zz" else 1) for s in want)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixed_rows_and_shards(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: sorted(r.shards) for r in mixing.mix(docs).collect()}
    rows = mixing.shuffle_locally(mixing.mixed_rows(docs)).select("doc_id", "_shard").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r._shard)
    assert {d: s for d, s in taken.items() if s} == {d: sorted(s) for d, s in got.items()}


# Chat formatting


def test_round_trip_of_odd_texts(spark):
    odd = [r"\### Assistant: </turn> ok", "", None, '<turn role="user">', r"\b\l\q\\", '"><"', "</turn>\n", "<image 0 tokens=\"3\"/>", "é\n\n🙂"]
    rows = [(1, i, ["user", "assistant", 'sys"<\\', None][i % 4], t) for i, t in enumerate(odd)] + [(None, None, "assistant", "x"), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.array(chat_format.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2, None):
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in mine), "".join(t for r, t in mine if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(mine), len(loss))
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_parts_and_attachments(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "look <"), part("image", ref="a.png", w=56, h=29), part("audio", ref="b.wav", s=1.1), part("text", "end")]), (1, 1, "assistant", [part("document", ref="c", p=3), part("text", "ok")]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    (r,) = chat_format.format_conversations(df).collect()
    assert r.formatted.split("\n")[0] == '<turn role="user">look \\l<image 0 tokens="4"/><audio 1 tokens="28"/>end</turn>'
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 28), ("document", "c", 768)]
    (t,) = spark.createDataFrame([(r.formatted,)], "f string").select(chat_format.read_back(F.col("f")).alias("t")).collect()
    assert [(x.role, x.text) for x in t.t] == [("user", "look <end"), ("assistant", "ok"), ("user", "")]
