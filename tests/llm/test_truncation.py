import numpy as np

from codexlake.llm import truncation

SCHEMA = "id string, summary string, model string, log_odds string, `group` string"
LEADS = ("The towers of {} were built by {} in {}.", "Under {}, the court at {} moved twice, in 1{} and later.", "St. {} of {} counted {} mills near the river.", "Trade with {} brought barges to {}, roughly {} km away.")
ENDS = ("Work on the mills of {} continues under {}.", "Its roads are listed by the Council of {}.[17]", "The collection of {} now holds ports, bells, etc.", "In the words of {}, “nothing was ever plain again!”", "Whether {} saw the fair is an open question, is it not?")


def corpus(n=1200, cut_every=20):
    rng = np.random.default_rng(0)

    def name():
        return "".join(rng.choice(["Tel", "ora", "vin", "mara", "dun", "esk"], 3)).capitalize()

    rows, cut = [], set()
    for i in range(n):
        text = " ".join(LEADS[rng.integers(4)].format(name(), name(), rng.integers(100, 999)) for _ in range(5))
        end = ENDS[rng.integers(5)].format(name(), name())
        if i % cut_every == 0:
            text = (text + " " + end[: int(rng.integers(5, 20))]).rstrip(" .") + ("", "…", " [...]", " \n")[i // cut_every % 4]
            cut.add(f"{i}")
        else:
            text += " " + end + ("", " ", "\n\n")[i % 3]
        rows.append((f"{i}", text, f"m{i % 3}"))
    return rows, cut


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    judged = truncation.cut_values(table(spark, rows), "id", ("summary",), keep=("model",))
    got = {r.id for r in judged.filter("is_cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.01 * len(rows)
    shares = {r.model: (r.n_values, r.n_cut) for r in truncation.cut_shares(judged, ("model", "field")).collect()}
    assert sum(n for n, _ in shares.values()) == len(rows) and sum(c for _, c in shares.values()) == len(got)


def test_no_values_nulls_blanks_and_long_texts(spark):
    rows, _ = corpus(200)
    rows += [("null", None, "m"), ("empty", "", "m"), ("blank", " \n", "m"), ("dots", "…", "m"), (None, rows[1][1], "m"), rows[2], ("long", rows[1][1] * 2000, "m")]
    judged = truncation.cut_values(table(spark, rows), "id", ("summary",)).collect()
    found = {r.id: r.is_cut for r in judged}
    assert not {"null", "empty", "blank"} & set(found) and found["dots"] is False and found["long"] is False and None in found
    assert sum(r.id == rows[2][0] for r in judged) == 2
    assert truncation.cut_values(table(spark, []), "id", ("summary",)).collect() == []


def test_any_number_of_spaces_and_marks_may_follow_a_cut(spark):
    rows, cut = corpus()
    padded = {i: pad for i, pad in zip(sorted(cut), (" " * 3000, "\n" * 5000, "\u00a0" * 2500, " ..." * 1000))}
    plain = {r.id: r for r in truncation.cut_values(table(spark, rows), "id", ("summary",)).collect()}
    got = {r.id: r for r in truncation.cut_values(table(spark, [(i, t + padded.get(i, ""), m) for i, t, m in rows]), "id", ("summary",)).collect()}
    assert all(plain[i].is_cut and got[i].is_cut for i in padded)
    assert {i for i, r in got.items() if r.is_cut} == {i for i, r in plain.items() if r.is_cut}


def test_symbols_fold_names_numbers_and_capitals():
    codes = np.frombuffer("Ann met Teloravin in 1503. B. SONS LTD.".encode("utf-32-le"), np.uint32)
    out, _ = truncation.symbols(codes, np.zeros(len(codes), int))
    assert "".join(map(chr, out)) == f"ann met {chr(truncation._NAME)} in 0000. {chr(truncation._INITIAL)}. sons ltd."


def languages(spark, rows, extra):
    schema = "id string, summary string, model string, lang string"
    return spark.createDataFrame([(i, t, m, "en") for i, t, m in rows] + extra, schema)


def test_complete_texts_of_a_rare_language_are_not_flagged(spark):
    rows, cut = corpus(6000)
    complete = [t for i, t, _ in rows if i not in cut][:15]
    extra = [(f"xx{j}", t, "m", "XX ") for j, t in enumerate(complete)] + [(f"yy{j}", "¿" + "qué tal están ¡¿ " * 5 + "?", "m", None) for j in range(2)]
    extra += [("xx-cut", rows[1][1] + " Its roads are list", "m", "xx"), ("zz-cut", rows[1][1] + " Trade with the har", "m", "zz")]
    judged = truncation.cut_values(languages(spark, rows, extra), "id", ("summary",), lang_col="lang").collect()
    found = {r.id for r in judged if r.is_cut}
    assert len(found & cut) >= 0.95 * len(cut) and {"xx-cut", "zz-cut"} <= found
    assert not [i for i in found if i[:2] in ("xx", "yy") and i != "xx-cut"]


def test_groups_beyond_the_counters_of_a_task_count_alike(spark, monkeypatch):
    rows, _ = corpus(600)
    table = spark.createDataFrame([(i, t, m, f"l{int(i) % 7}") for i, t, m in rows], "id string, summary string, model string, lang string").coalesce(1)

    def judged():
        return {r.id: (round(r.log_odds, 9), r.is_cut) for r in truncation.cut_values(table, "id", ("summary",), lang_col="lang").collect()}

    want = judged()
    monkeypatch.setattr(truncation, "COUNTERS", 1)
    assert judged() == want


def test_trailing_marks_are_stripped_as_a_pattern_would():
    import re

    pattern = re.compile(r"(?:\s|" + "|".join(map(re.escape, sorted(truncation.CUT_MARKS, key=len, reverse=True))) + r")+$")
    rng = np.random.default_rng(6)
    pieces = ["a", " ", "\n", ".", "..", "...", "…", "[...]", "(…)", "[", ")", "\u00a0", "�", "b. "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 9))))
        assert truncation.bare(text) == pattern.sub("", text)


def test_contexts_of_short_tails_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(7)
    words = ["Teloravin", "in", "1503", "the", "of", "Xy", "q.", "Éclat-Monde", "w" * 300, "W" * 400]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 400)))) for _ in range(60)] + ["", "a", "N" * 5000, " "]
    short = truncation._end_hashes(texts)
    monkeypatch.setattr(truncation, "SHORT_TAIL", 1_000_000)
    assert (short == truncation._end_hashes(texts)).mean() > 0.99 and (short[:40] == truncation._end_hashes(texts)[:40]).all()
