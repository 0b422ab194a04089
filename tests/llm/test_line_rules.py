import re
from collections import Counter, defaultdict

from lectern.llm import line_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, min_docs, least):
    norm = lambda line: " ".join(w.encode().lower().decode() for w in WORD.findall(line))
    docs = defaultdict(set)
    for _, text, source in rows:
        docs[source or ""].add(tuple(x for x in map(norm, (text or "").split("\n")) if x))
    often = {}
    for host, texts in docs.items():
        seen = Counter(x for t in texts for x in set(t))
        often[host] = {x for x, n in seen.items() if n > min_docs}
    out = []
    for doc, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = [x for x in lines if norm(x) in often[source or ""]]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and len(words) - lost >= least * len(words)
        clean = "\n".join(x for x in text.split("\n") if not (WORD.search(x) and norm(x) in often[source or ""]))
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed, len(gone), lost, kept, clean))
    return sorted(out, key=str)


def test_against_brute_force(spark, sf):
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(120).select("doc_id", "text", "source").collect()
    rows = [tuple(r) for r in some]
    body = lambda k, n=60: " ".join(f"w{k}x{i}é" for i in range(n))
    rows += [(1000 + k, f"  Subscribe\tNOW to our news!\n{body(k)}\nall rights  RESERVED", "hot") for k in range(30)]
    rows += [(1100 + k, f"subscribe now to our news!\n{body(k, 3)}\nALL RIGHTS reserved {'é ' * (k % 3)}", "hot") for k in range(9)]
    rows += [(1150 + k, f"{body(9, 45)}\n{body(90 + k, 20)}\n{body(8, 25)}", "hot") for k in range(9)]
    rows += [(1200, "the very same page\n" * 30 + body(7), "copies")] * 40
    rows += [(1300, "x y z " * 60, "hot"), (1301, None, None), (1301, "", None), (None, "\n\n \t\n", "hot"), (None, body(3), None), (1302, "\x0b".join(map(str, range(80))) + "\n\n", ""), (1303, "long " * 40_000, "hot"), (1304, "a\nb\na\n a\nb \n" + body(5), "hot")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, n_words int, frequent string")
    got = sorted((tuple(r) for r in line_rules.judge(docs, min_docs=5).collect()), key=str)
    assert got == brute(rows, 5, 0.5)
    assert any(not r[9] and not r[6] for r in got) and any(r[9] and r[7] for r in got)
    shuffled = line_rules.BROADCAST_LINES
    try:
        line_rules.BROADCAST_LINES = -1
        assert sorted((tuple(r) for r in line_rules.judge(docs, min_docs=5).collect()), key=str) == got
    finally:
        line_rules.BROADCAST_LINES = shuffled
    assert line_rules.judge(docs.limit(0)).collect() == []
