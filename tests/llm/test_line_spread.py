from docloom.llm import line_spread


def plain(rows, least=5):
    blanks = " \t\r\x0b\x0c"
    sites = {}
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line.strip(blanks), set()).add(site)
    out = []
    for i, text, _, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(blanks) or len(sites[x.strip(blanks)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, corpus, empty):
    docs, rows = corpus
    for least in (2, 4, 5):
        got = sorted((tuple(r) for r in line_spread.clean_lines(docs, min_sites=least).collect()), key=str)
        assert got == plain(rows, least)
    assert line_spread.clean_lines(empty).count() == 0


def test_lines_near_the_threshold_are_counted(spark):
    """With coarse sketches and many sites, estimates err; the result doesn't."""
    rows = [(100 * n + k, f"line {n}\nown {n} {k}", "en", f"site{k}") for n in range(44, 57) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((tuple(r) for r in line_spread.clean_lines(docs, min_sites=50, precision=6, margin=0.9).collect()), key=str)
    assert got == plain(rows, 50)
