import re

import numpy as np

from tarnwell.llm import quality_rules

from .cases import SCHEMA, by_id, docs, twins

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, lines = W.findall(text or ""), [x for x in (text or "").split("\n") if W.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else set(windows)
    hit = {j for k, w in enumerate(windows) if w in again for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    texts = [None, "", "a\nb\na\n a\n\n\n", "one two three four five six one two three four five", "a a a a a a", "# $x|<>&* %\n#", "x\r\nx\r\n", "é ü\u00a0z 漢字 😀", "one two three four five\none two three four five\n" * 3]
    rows = [(k, t, None, "h", 0) for k, t in enumerate(texts)]
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, SCHEMA)))
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def _host(n):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    return [(k, f"Click  HERE to subscribe\n{body(k)}" if k < n else body(k), "en", "big" if k < 60 else None, 0) for k in range(62)] + [(99, "click here to subscribe\nclick here TO subscribe\nthree more words", "en", "big", 0)]


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    got = by_id(quality_rules.judge(spark.createDataFrame(_host(20), SCHEMA)))
    assert got[0].n_removed_words == 4 and got[0].kept and got[0].cleaned == _host(0)[0][1]
    assert got[30].n_removed_words == 0 and got[30].kept
    assert got[99].n_removed_words == 8 and not got[99].base_failed and not got[99].kept
    rare = by_id(quality_rules.judge(spark.createDataFrame(_host(3), SCHEMA)))
    assert rare[0].n_removed_words == 0 and rare[99].kept


def test_join_path_equals_broadcast(spark):
    df = spark.createDataFrame(_host(20), SCHEMA)
    rows = lambda: sorted(map(str, quality_rules.judge(df).collect()))
    broadcast, setting = rows(), "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(setting, -1)
        assert rows() == broadcast
    finally:
        spark.conf.unset(setting)


def test_lines_that_a_polynomial_hash_confuses(spark):
    a, b = twins()
    text = f"{a}\n{b}\n{b}\n" + " ".join(f"{w} one two three four" for w in (a, b, a, b))
    rows = [(k, text, "en", "h", 0) for k in range(2)] + [(2, f"{a} 1 2 3 4 {b} 1 2 3 4", "en", "h", 0)]
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, SCHEMA)))
    for k, t, *_ in rows:
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == brute(t)


def test_windows_of_one_hash_are_compared():
    words = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 6, 1, 2, 3, 4, 5], np.uint64)
    first, owner = np.array([0, 5, 10]), np.zeros(3, np.int64)
    assert quality_rules._found_twice(owner, first, words, words, np.zeros(3, np.uint64)).tolist() == [True, False, True]
    assert quality_rules._found_twice(np.array([0, 0, 1]), first, words, words, np.zeros(3, np.uint64)).tolist() == [False, False, False]


def test_rows(spark):
    got = quality_rules.judge(docs(spark)).collect()
    assert len(got) == 11
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[6] and not any(kept[k] for k in (2, 3, 4, 5, 8, 9, None))
    assert {r.cleaned for r in got if r.doc_id == 2} == {None}
    assert quality_rules.judge(docs(spark, [])).count() == 0


def counted(rows):
    """Removed words and verdicts of (id, text, host), by counting sets of ids."""
    normal = lambda line: tuple(W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    key = [(n, None) if i is None else i for n, (i, *_) in enumerate(rows)]
    holders, hosts = {}, {}
    for k, (_, text, host) in zip(key, rows, strict=True):
        hosts.setdefault(host or "", set()).add(k)
        for line in (text or "").split("\n"):
            if normal(line):
                holders.setdefault((host or "", normal(line)), set()).add(k)
    bad = {x for x, ids in holders.items() if len(ids) >= 30 or (len(ids) >= 5 and 10 * len(ids) >= len(hosts[x[0]]))}
    for i, text, host in rows:
        n, *_, again = brute(text)
        gone = sum(len(normal(x)) for x in (text or "").split("\n") if (host or "", normal(x)) in bad)
        failed = n < 10 or 100 * again > 20 * n
        yield str(i), n, gone, not failed and 2 * (n - gone) >= n and n - gone >= 10


def test_distinct_documents_of_large_and_small_hosts(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    many, some = "Read all about it here and tell every friend of yours today", "Sign in to vote now"
    rows = [(k, body(k), "large") for k in range(400)]  # two lines: in 30 and in 29 of 460 documents and more
    rows += [(1000 + k, f"{body(1000 + k)}\n{many if k < 30 else some}", "large") for k in range(59)]
    rows += [(2000, f"{many}\n{many}\nonly eight words of its own are left", "large")]
    rows += [(3000, f"mine alone {body(1)}\n{some}", "large")] * 40  # one document, forty times
    rows += [(None, f"nobody's line {body(2)}", "nulls")] * 5 + [(k, body(k), None) for k in range(4)]
    rows += [(k, f"{some}\n{body(k)}", "small") for k in range(5)] + [(k, body(k), "small") for k in range(5, 51)]
    got = quality_rules.judge(spark.createDataFrame([(i, t, "en", h, 0) for i, t, h in rows], SCHEMA).repartition(3), with_text=False).collect()
    want = sorted(counted(rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed_words, r.kept) for r in got) == want
    assert {w[2] for w in want if w[0] == "3000"} == {5} and not [w for w in want if w[0] == "2000"][0][3]
