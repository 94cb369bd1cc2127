"""Random contracts on random rows, against a row-by-row model in plain Python."""

import random
import re

import pytest

from tablepact import Contract, annotate, split, summarise

NUMBERS = [None, "x", "", "0", "1", "2", "3", "-4", "10"]
WORDS = [None, "", "a", "ab", "abc", "Zed", "a@b.co", "10", "it's"]


def random_field(dice):
    if dice.random() < 0.5:
        rules = {"type": "integer"}
        options = {
            "minimum": dice.randint(-2, 3),
            "maximum": dice.randint(0, 5),
            "exclusiveMinimum": dice.randint(-2, 2),
            "exclusiveMaximum": dice.randint(1, 9),
            "multipleOf": dice.randint(1, 3),
            "enum": [dice.choice([0, 1, 2, "1", 10, None]) for _ in range(3)],
            "const": dice.choice([1, 2]),
            "pattern": "^[0-9]",
        }
    else:
        rules = {"type": "string"}
        options = {
            "minLength": dice.randint(0, 2),
            "maxLength": dice.randint(1, 3),
            "pattern": dice.choice(["a", "^[A-Z]", "b$", "'"]),
            "enum": [dice.choice(["a", "ab", "10", 10, True]) for _ in range(3)],
            "const": dice.choice(["a", "10"]),
            "format": "email",
        }
    chosen = dice.sample(sorted(options), dice.randint(1, 4))
    return {**rules, **{k: options[k] for k in chosen}}


def typed(text, kind):
    if kind == "string" or text is None:
        return text
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def failures(text, rules, required):
    """Names of the rules the value breaks, in reporting order."""
    value = typed(text, rules["type"])
    found = ["is_not_null"] if required and value is None else []
    members = {"integer": int, "string": str}[rules["type"]]

    def check(name, keyword, holds, subject):
        if keyword in rules and subject is not None and not holds(subject):
            found.append(name)

    def allowed(values):
        return [v for v in values if type(v) is members]

    check("is_email", "format", lambda v: re.search(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", v), text)
    check("is_in_list", "enum", lambda v: v in allowed(rules["enum"]), value)
    check("is_equal_to", "const", lambda v: v == rules["const"], value)
    if "minimum" in rules and "maximum" in rules:
        check("is_in_range", "minimum", lambda v: rules["minimum"] <= v <= rules["maximum"], value)
    else:
        check("is_not_less_than", "minimum", lambda v: v >= rules["minimum"], value)
        check("is_not_greater_than", "maximum", lambda v: v <= rules["maximum"], value)
    check("exclusive_minimum", "exclusiveMinimum", lambda v: v > rules["exclusiveMinimum"], value)
    check("exclusive_maximum", "exclusiveMaximum", lambda v: v < rules["exclusiveMaximum"], value)
    check("min_length", "minLength", lambda v: len(v) >= rules["minLength"], text)
    check("max_length", "maxLength", lambda v: len(v) <= rules["maxLength"], text)
    check("regex_match", "pattern", lambda v: re.search(rules["pattern"], v), text)
    check("multiple_of", "multipleOf", lambda v: v % rules["multipleOf"] == 0, value)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_random_contract(spark, seed):
    dice = random.Random(seed)
    fields = {f"f{n}": random_field(dice) for n in range(5)}
    required = [name for name in fields if dice.random() < 0.4]
    contract = Contract.from_schema({"required": required, "properties": fields})
    pool = {name: NUMBERS if rules["type"] == "integer" else WORDS for name, rules in fields.items()}
    rows = [(n, *(dice.choice(pool[name]) for name in fields)) for n in range(60)]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"{name} string" for name in fields))

    expected = {
        row[0]: [
            (rule, name)
            for name, text in zip(fields, row[1:])
            for rule in failures(text, fields[name], name in required)
        ]
        for row in rows
    }
    assert {r.n: [(e.check, e.column) for e in r._errors] for r in annotate(df, contract).collect()} == expected
    assert {r.n for r in split(df, contract)[0].collect()} == {n for n, errors in expected.items() if not errors}
    for r in summarise(df, contract).collect():
        assert r.violations == sum((r.check, r.column) in errors for errors in expected.values())
