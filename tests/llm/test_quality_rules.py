import re
from collections import Counter

from slotwise.llm.quality_rules import COUNTS, LineRules, clean_lines


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_counts(odd_docs, no_docs):
    want = sorted((str(r.doc_id), *brute(r.text)) for r in odd_docs.collect())
    rows = clean_lines(odd_docs).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    assert clean_lines(no_docs).count() == 0


def test_line_rules(spark):
    prose = "\n".join(" ".join(f"word{k}x{j}" for j in range(10)).capitalize() + "." for k in range(12))
    bad = ["Home | News | About | Contact", "All rights reserved.", "BUY!! NOW!! CHEAP!! STUFF!!", "a line of eight words or more without end", "A$$$ b%%% c### d*** e"]
    docs = spark.createDataFrame([(1, prose), (2, prose + "\n" + "\n".join(bad)), (3, prose + "\n" + "\n".join(f"{k} | " * 40 for k in range(9)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in clean_lines(docs).collect()}
    assert (rows[1].kept, rows[1].n_failed_lines, rows[1].cleaned) == (True, 0, prose)
    assert (rows[2].kept, rows[2].n_failed_lines, rows[2].cleaned) == (True, 5, prose + "\n")
    assert not rows[3].kept
    assert clean_lines(docs, LineRules(max_lost_percent=1)).where("doc_id = 2 and kept").count() == 0


def test_phrases_are_literal(spark):
    line = "Prose that says (C) HERE and c++ and ends."
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    for phrases, n in ((("(c) here",), 1), (("c++",), 1), (("(C) Here",), 1), (("c..",), 0), ((), 0), (("",), 0)):
        assert clean_lines(docs, LineRules(boilerplate=phrases)).first().n_failed_lines == n
