from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from labelkit.functions import text as t


@pytest.mark.parametrize(
    "answer, stop, safe, want",
    [
        ("[3, 7]@ confidence 80%", True, True, ["3", "7"]),
        ("x [ 3,\n7 ]@", True, True, ["3", "7"]),
        ("[3, 7] confidence 80%", True, True, []),
        ("[3, 7] confidence 80%", False, True, ["3", "7"]),
        ("This is SAFE", True, True, ["safe"]),
        ("This is SAFE", True, False, []),
        ("[a]@ nothing", True, True, []),
        ("", True, True, []),
        (None, True, True, []),
    ],
)
def test_parse_labels(one, answer, stop, safe, want):
    assert one(t.parse_labels("a", stop, safe), a=(answer, "string")) == want


@pytest.mark.parametrize("raw, want", [(" a@", "a"), ("a@ ", "a@"), ("\n a \t", "a"), ("@", ""), ("a@@", "a@")])
def test_strip_stop(one, raw, want):
    assert one(t.strip_stop("a"), a=(raw, "string")) == want


def test_labels_must_be_parsed_before_the_stop_mark_is_cut(one):
    raw = "[1]@"
    assert one(t.parse_labels("a"), a=(raw, "string")) == ["1"]
    assert one(t.parse_labels(t.strip_stop("a")), a=(raw, "string")) == []


@pytest.mark.parametrize(
    "answer, expected, want",
    [
        ("[3, 7]@ confidence 80%", ["3", "7"], 1.0),
        ("[3, 7]@ confidence 80", ["3", "7"], 0.0),
        ("[3, 7]@ confidence 80%", ["7"], 0.4 * 2 / 3),
        ("[7, 3]@ confidence 80%", ["7"], 0.6 + 0.4 * 2 / 3),
        ("[7, 7]@ confidence 80%", ["7"], 1.0),
        ("[7]@ confidence 80%", [], 0.0),
        ("no list, confidence 9%", ["7"], 0.0),
    ],
)
def test_label_score(one, answer, expected, want):
    got = one(t.label_score("a", F.col("e")), a=(answer, "string"), e=(expected, "array<string>"))
    assert got == pytest.approx(want)


def test_list_variant_of_the_score(one):
    got = one(t.label_set_score(F.col("p"), F.col("e")), p=(["a", "b"], "array<string>"), e=(["a"], "array<string>"))
    assert got == pytest.approx(0.6 + 0.4 * 2 / 3)


@pytest.mark.parametrize(
    "raw, want", [("A, B", ["A", "B"]), ("B,A", ["B", "A"]), (" A ", ["A"]), ("", []), (None, []), (",A,, ", ["A"])]
)
def test_split_labels(one, raw, want):
    assert one(t.split_labels("a"), a=(raw, "string")) == want


def test_join_labels(one):
    assert one(t.join_labels("a"), a=(["A", "B"], "array<string>")) == "A, B"


@pytest.mark.parametrize(
    "truth, pred, default, compat",
    [
        ("Safe Content", "Safe Content", True, False),
        ("", "Safe Content", True, True),
        ("A, B", "B,A", True, True),
        ("A", "A, Safe Content", True, False),
        ("A", "B", False, False),
    ],
)
def test_label_set_equality(one, truth, pred, default, compat):
    for switch, want in ((False, default), (True, compat)):
        same = t.same_labels(t.label_set("t", compat=switch), t.predicted_label_set("p", compat=switch))
        assert one(same, t=(truth, "string"), p=(pred, "string")) is want


CATS = ["GORE", "WEAPONS", "Safe Content"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("x\n GORE, WEAPONS \nGORE", "GORE, WEAPONS"),
        ("nothing", "Safe Content"),
        ("gore", "Safe Content"),
        (None, "Safe Content"),
    ],
)
def test_parse_category_line(one, raw, want):
    assert one(t.parse_category_line("a", CATS), a=(raw, "string")) == want


def test_parse_category_line_skips_a_repeated_prompt(one):
    prompt = "say GORE or\nelse Safe Content.\n"
    assert one(t.parse_category_line("a", CATS, prompt), a=(prompt + "WEAPONS", "string")) == "WEAPONS"
    assert one(t.parse_category_line("a", CATS), a=(prompt + "WEAPONS", "string")) == "say GORE or"


def test_onehot_conf(one):
    got = one(t.onehot_conf(t.split_labels("a"), CATS), a=("GORE, x", "string"))
    assert got == {"GORE": 1.0, "WEAPONS": 0.0, "Safe Content": 0.0}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Prompt 1: a\nnote\nPrompt 2: b:c", ["a", "b:c"]),
        ("x\n\ny", ["x", "y"]),
        ("Prompt without colon\n\n z", ["Prompt without colon", " z"]),
        (" Prompt 1: a", ["Prompt 1: a"]),
    ],
)
def test_split_prompts(one, raw, want):
    assert one(t.split_prompts("a"), a=(raw, "string")) == want


def test_unescape_newlines(one):
    assert one(t.unescape_newlines("a"), a=("x\\ny", "string")) == "x\ny"


def test_stamps(one):
    at = F.lit(datetime.datetime(2024, 1, 31, 23, 5, 9, 120000)).cast("timestamp")
    assert one(t.run_stamp(at)) == "20240131_230509"
    assert one(t.iso_stamp(at)) == "2024-01-31T23:05:09.120000"


@pytest.mark.parametrize("name, want", [("a.PNG", True), ("b.jpeg", True), ("c.txt", False), ("png", False)])
def test_has_extension(one, name, want):
    assert one(t.has_extension("a", ["png", "jpeg"]), a=(name, "string")) is want


@pytest.mark.parametrize("pred, gold, want", [(" A  b\n", "a B", 1.0), ("a", "b", 0.0), (None, "a", 0.0)])
def test_exact_match(one, pred, gold, want):
    assert one(t.exact_match("p", "g"), p=(pred, "string"), g=(gold, "string")) == want


@pytest.mark.parametrize("pred, gold, want", [("a", "a", 1), ("a", "b", -1), (None, "a", -1)])
def test_reward(one, pred, gold, want):
    assert one(t.reward("p", "g"), p=(pred, "string"), g=(gold, "string")) == want


def test_coalesce_nonempty_and_percent(one):
    assert one(t.coalesce_nonempty("a", "b", "c"), a=(None, "string"), b=("", "string"), c=("x", "string")) == "x"
    assert one(t.percent(F.lit(1), F.lit(8))) == 12.5
