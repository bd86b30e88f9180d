from collections import Counter, defaultdict

from helpers import SCHEMA, clashing, empty, odd, odd_rows, prose, words

from sparkcomm.llm import quality


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_measures_equal_brute_force(spark):
    rep = "a b c d e f g h i j"
    texts = [f"{rep} x {rep}", f"{rep} {rep} {rep}", "z " * 8, "z " * 9, "z " * 7, "# $ <b> & |\n\n# $ <b> & |\n \n", f"{prose(1, 100)} {prose(1, 100)}", "a\r\nb\r\na\r\n"]
    table = [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts)] + odd_rows()
    got = quality.assess(clashing(spark.createDataFrame(table, SCHEMA))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(r[0]), *brute(r[1])) for r in table)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.assess(empty(spark)).count() == 0 and quality.keep(empty(spark)).count() == 0


def test_boilerplate_lines_of_a_host_go(spark):
    menu = "\n".join(f"menu item {i} of the site here" for i in range(8))
    table = [(i, f"{prose(i, 4)}\n{menu}\n{prose(1000 + i, 3)}", "en", "shop", 0) for i in range(30)]  # little else
    table += [(100 + i, f"{menu}\n{prose(2000 + i, 120)}", "en", "shop", 0) for i in range(30)]  # enough else
    table += [(200 + i, f"{prose(3000 + i, 4)}\n{menu}", "en", "other", 0) for i in range(4)]  # rare on this host
    table += [(300 + i, "\n".join(prose(4000 + j, 9) for j in range(6)), "en", "shop", 0) for i in range(40)]  # copies of one document
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(table, SCHEMA)).collect()}
    assert not any(got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["kept"] and got[100 + i]["n_boilerplate_words"] == 56 for i in range(30))
    assert all(got[200 + i]["kept"] and got[200 + i]["n_boilerplate_words"] == 0 for i in range(4))
    assert all(got[300 + i]["kept"] for i in range(40))


def test_keep_returns_whole_rows(spark):
    docs = clashing(spark.createDataFrame([*odd_rows(), (50, prose(9, 80), "en", "a", 1), (50, prose(9, 80), "en", "a", 1), (None, prose(8, 80), None, None, 1)], SCHEMA))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    want = defaultdict(int)
    for r in quality.assess(docs).where("kept").collect():
        want[str(r["doc_id"])] += 1
    got = defaultdict(int)
    for r in kept.collect():
        got[str(r["doc_id"])] += 1
    assert got == want and got["50"] == 2


def test_distinct_documents_of_shared_lines(spark):
    """One own line each, and 30 shared ones, which hash lower than most own ones."""
    shared = "\n".join(prose(5000 + i, 7).replace("\n", " ") for i in range(30))
    table = [(i, f"{shared}\nown line of page {chr(97 + i // 26)}{chr(97 + i % 26)}", "en", "shop", 0) for i in range(60)]
    table += [(100 + i, f"{shared}\nthe same page", "en", "few", 0) for i in range(60)]  # copies of one document
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[i]["n_boilerplate_words"] == 210 and not got[i]["kept"] for i in range(60))
    assert all(got[100 + i]["n_boilerplate_words"] == 0 for i in range(60))


def test_long_lines_are_counted(spark):
    legal = prose(6000, 60).replace("\n", " ")
    table = [(i, f"{prose(6100 + i, 5)}\n{legal}", "en", "shop", 0) for i in range(30)]
    got = quality.assess(spark.createDataFrame(table, SCHEMA)).collect()
    assert all(r["n_boilerplate_words"] == 60 and not r["kept"] for r in got)
