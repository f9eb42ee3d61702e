from collections import Counter, defaultdict

from hushframe.llm import line_dedup


def brute(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    for _, host, text in rows:
        pages[host] += 1
        seen[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for doc, host, text in rows:
        lines = (text or "").split("\n")
        bad = {x for x, n in seen[host].items() if n >= least and n > ratio * pages[host]}
        stay = [x for x in lines if x.strip(" ") not in bad]
        out.append((doc, host, "\n".join(stay), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rows = [(i, "h%d" % (i % 3), f"menu\nown line {i}\n\n  footer  \nshared {i % 4}") for i in range(60)]
    rows += [(100 + i, None, "menu\nx") for i in range(4)] + [(200, "solo", "menu\nmenu"), (201, "h0", None), (202, "h0", ""), (202, "h0", ""), (None, "h1", "menu")]
    rows += [(300, "h2", "long " * 200_000 + "\nfooter")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, host int")
    for ratio, least in ((0.3, 3), (0.05, 2), (0.9, 3)):
        got = line_dedup.clean_lines(docs, ratio, least).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, ratio, least)
    assert line_dedup.clean_lines(docs.where("false")).count() == 0
