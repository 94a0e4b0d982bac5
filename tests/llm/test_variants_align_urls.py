"""Spelling variants, token alignment and URL rules against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from watchtide.llm import align, queries, spelling
from watchtide.llm.url_rules import UrlTrie, judge_urls

LETTERS = "abcdefghijklmnopqrstuvwxyzéÀß×÷"


# ---- spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs, min_chars=6, min_count=5, drop_every=199):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def plain_groups(words, factor=5):
    by = defaultdict(set)  # what is left of a word without one code point, or the word
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    friends = {w: {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by[x] if near(w, v)} for w in words}
    best = {w: min(friends[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= factor * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(friends[w]), form[w] and words[form[w]]) for w, n in words.items()}


def groups_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_op11_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = groups_of(queries.op11_spelling_variants(spark, sf))
    assert len(got) == len(set(got)) and set(got) == plain_groups(plain_words(docs)) and any(g[1] for g in got)


@pytest.mark.parametrize("how", [{}, {"merge": 1}, {"merge": 4, "longest": 3}, {"most_in_list": 3}, {"most_grams": 8}, {"longest": 9}, {"longest": 2, "merge": 1}])
def test_near_words_of_families(spark, how):
    """Random words and their relatives, short ones too, whatever the dictionary and the bounds of the lists."""
    r = random.Random(5)
    words = {"a", "b", "ab", "ba", "aaaa", "aaaaa", "aaaaaa", "abab", "ababab", "baba", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    for _ in range(60):
        w = "".join(r.choice(LETTERS[:5] if r.random() < 0.5 else LETTERS) for _ in range(r.randint(1, 12)))
        words.add(w)
        for _ in range(5):
            i = r.randint(0, len(w))
            words.add(r.choice([w[:i] + r.choice(LETTERS) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(LETTERS) + w[i + 1 :]]))
    words = {w: r.randint(1, 300) for w in words if w}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(x["a"], x["b"]) for x in spelling.near_words(df, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}
    assert set(groups_of(spelling.group_variants(df, **how))) == plain_groups(words)


def test_bound_holds_for_every_edit():
    """Grams that an edit leaves alone are there in the other word; the first keys share what is promised."""
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 10))) for _ in range(300)]
    counted = Counter(s[p : p + q] for w in words for s in [spelling.BEFORE + w + spelling.BEHIND] for q in (2, 3, 4) for p in range(len(s) - q + 1))
    index = spelling.GramIndex({g: n for g, n in counted.items() if n >= 20})
    for w in words:
        grams, affected = index.decompose(w)
        mine = {(g, p) for _, g, p in grams}
        for i in range(len(w) + 1):
            for v in {w[:i] + c + w[i:] for c in "abcd"} | {w[:i] + c + w[i + 1 :] for c in "abcd"} | {w[:i] + w[i + 1 :]}:
                if v == w or not near(v, w) or not v:
                    continue
                theirs = {(g, p) for _, g, p in index.decompose(v)[0]}
                shift = len(v) - len(w)
                assert sum((g, p) in theirs or (g, p + shift) in theirs for g, p in mine) >= len(mine) - affected
                (a, need), (b, other) = index.keys(w), index.keys(v)
                assert sum((g, p) in b or (g, p + shift) in b for g, p in a) >= min(need, other)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w5") for i in range(50)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {a: "w37" for a, _ in links}


def test_op11_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, other columns with clashing names."""
    docs = [(None, "running running"), (1, None), (2, ""), (3, "Running,running;running " * 9), (3, "Running,running;running " * 9), (4, "runnin runnin runnin runnin runnin " + "\u00c9tudes \u00e9tudes " * 6), (5, "aunning cunning " * 300 + "bunning " * 300), (6, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, n int, word string, gram string")
    got = set(groups_of(spelling.spelling_variants(df, counts={"drop_every": 199})))
    assert got == plain_groups(plain_words(docs))
    assert {g[:3] for g in got} >= {("running", "aunning", "aunning"), ("\u00c9tudes", None, "\u00c9tudes")}  # of the equal ones the smallest
    assert groups_of(spelling.spelling_variants(df.limit(0))) == []


# ---- token alignment


def plain_alignment(docs):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    rows, counts = [], Counter()
    for i, text in docs:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, k = [], 0
        for x, (end, size) in enumerate(zip(ends_a, map(len, bytes_a))):
            while ends_b[k] <= end - size:
                k += 1
            j = k
            while j < len(b) and ends_b[j] - len(bytes_b[j]) < end:
                links.append((a[x], b[j]))
                j += 1
        counts.update(links)
        both, groups, x, y = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in both:
            p, q = ends_a.index(end) + 1 if len(a) < 300 else np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        rows.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (-1 if i is None else i, len(a), len(b), len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for i, a, b, g, k in rows
    )


def alignment_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def test_op12_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment_of(got) == plain_alignment(docs)


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 40, 1])
def test_op12_odd_rows(spark, most, monkeypatch):
    """Nulls, empty texts, all kinds of characters, special tokens as plain text, texts that a model changes, and
    few broadcast pairs."""
    r = random.Random(3)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "\u00e9", "\u65e5\u672c", "\U0001f600", "12", ".", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\u00a0", "\u2003", "e\u0301", "\x00", "'ll", "don't"]
    docs = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(1, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "no id"), (102, "a \u2581 b"), (103, "twice"), (103, "twice"), (104, " "), (105, "   lead and trail   "), (106, "w" * 3000), (107, "\n"), (108, "many words here " * 2000), (109, "\ufb01 \uff21")]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, n_a int, groups string, pair double").repartition(3)
    monkeypatch.setattr(align, "PARTIAL", 50)
    paths = queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model")
    got = align.align_tokenizers(df, *paths, most_pairs=most, groups=True)
    assert alignment_of(got) == plain_alignment(docs)
    assert all(hashlib.sha256(x["groups"].encode()).hexdigest() == x["groups_sha256"] for x in got.collect() if x["n_a"])
    assert align.align_tokenizers(df.limit(0), *paths, most_pairs=most).collect() == []
    assert align.align_tokenizers(df.where("doc_id in (100, 101)"), *paths).select("n_links", "n_best", "count_sum", "groups_sha256").distinct().collect() == [(0, 0, 0, "")]


# ---- URL rules


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


def test_op13_rules():
    r = random.Random(2)
    labels, segments = ["a", "b", "", "com", "org"], ["x", "xy", "", "y", "z"]
    for _ in range(300):
        host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
        path = lambda: r.choice(["", "/"]) + "/".join(r.choice(segments) for _ in range(r.randint(0, 3)))
        rules = [(r.choice(["allow", "block"]), host(), path()) for _ in range(r.randint(0, 12))]
        trie = UrlTrie(rules)
        for _ in range(20):
            h, p = host(), r.choice(["", "/"]) + path().lstrip("/")
            p = p if not p or p.startswith("/") else "/" + p
            want = plain_verdict(f"http://{h}{p}", rules)
            got = trie.longest(trie.nodes(want[0]), want[1])
            assert (got or (None, "allow")) == want[2:], (h, p, rules)


def test_op13_odd_rows(spark, sf):
    urls = [None, "", "no scheme", "://", "http://", "http://ORG", "http://Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://a.example.org?/es/", "http://notexample.org/es/", "x://y://org/", "http://com/de", "http://www.Com/de/\u00c9", "https://u@h.com:80/fr/", "http://h.com/fr/", "http://org./", "http://.org/", "http://h.com/de//", "HTTP://\u00c9.com/fr/#/de/", "http://h.net/\n/x", "http://h.com/" + "a/" * 50_000]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, "http://h.com/de/", "h", "r")] * 2 + [(None, "http://h.com/de/", "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = judge_urls(df, queries.URL_RULES, keep=("page_id", "host")).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(x) for x in got) == key((r[0], *plain_verdict(r[1], queries.URL_RULES)) for r in rows)
    assert judge_urls(df, [], default="block").where("verdict = 'block' AND rule IS NULL").count() == len(rows)
    assert judge_urls(df.limit(0), queries.URL_RULES).collect() == []
    with pytest.raises(ValueError):
        UrlTrie([("perhaps", "a", "/")])
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op13_url_filter(spark, sf).collect()}
    assert got == {r["page_id"]: plain_verdict(r["url"], queries.URL_RULES) for r in pages} and {v[-1] for v in got.values()} == {"allow", "block"}
