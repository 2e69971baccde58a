import re

from tablelift.llm import rules


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered = {i + k for i, window in enumerate(windows) if seen[window] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = [
    None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b c x a b c y b c x", "é 😀 # $$ |x|", "l\nl\n \nm\nl", "a\x0bb\x0cc\rd e",
    "one two three " * 40, "w " * 60, "\n".join(f"line {k % 3}" for k in range(50)), " ".join(f"u{k}" for k in range(80)),
]


def test_counts_and_verdicts_equal_plain_code(spark, documents):
    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").unionByName(documents.selectExpr("doc_id + 1000 AS doc_id", "text"))
    texts = {row["doc_id"]: row["text"] for row in frame.collect()}
    for row in rules.apply_rules(frame).collect():
        found = plain(texts[row["doc_id"]])
        assert tuple(row[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == found
        assert row["base_failed"] == (found[0] < 50 or 100 * found[4] > 50 * found[0]) and not (row["base_failed"] and row["kept"])


def test_order_changes_no_verdict_and_prefers_cheap_rejections(spark, documents):
    known = rules.default_rules()
    one, other = (
        {row["doc_id"]: row["kept"] for row in _kept(documents, order).collect()} for order in (known, tuple(reversed(known)))
    )
    assert one == other
    always = rules.Rule("always", rules.F.length("body") >= 0)
    never = rules.Rule("never", rules.F.length(rules.F.sha2("body", 512)) < 0)
    assert [rule.name for rule in rules.ordered_rules(documents, (never, always))] == ["always", "never"]


def _kept(documents, order):
    verdict = rules.F.lit(True)
    for rule in order:
        verdict = verdict & ~rule.rejects
    return rules.measured(documents.select("doc_id", "text")).select("doc_id", verdict.alias("kept"))


def test_odd_rows(odd, empty):
    rows = rules.apply_rules(odd).collect()
    by_id = {row["doc_id"]: row for row in rows}
    assert len(rows) == 11 and by_id[5]["n_repeat_words"] == 60_000 and by_id[6]["n_words"] == 1
    assert not any(row["kept"] for row in rows)
    assert rules.apply_rules(empty).count() == 0


def test_no_python_in_the_plan(documents):
    assert not re.search("Python|Arrow|Pandas", rules.apply_rules(documents)._jdf.queryExecution().toString())
