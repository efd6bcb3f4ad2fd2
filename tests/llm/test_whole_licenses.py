"""No keyword keeps a rule from what its pattern names."""

import itertools
from re import _parser

import pytest

from sourcelens.llm import license_rules, licenses


def examples(parsed):
    """For each way through a pattern's alternatives a text of it: the parts that must be there, in their shortest form."""
    ways = []
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ways.append([chr(arg)])
        elif kind == "BRANCH":
            ways.append([x for one in arg[1] for x in examples(one)])
        elif kind == "SUBPATTERN":
            ways.append(examples(arg[-1]))
        elif kind == "MAX_REPEAT":
            ways.append(["".join(x) for x in itertools.product(examples(arg[2]), repeat=arg[0])] if arg[0] else [""])
        elif kind == "ANY":
            ways.append(["0"])
        elif kind == "IN":
            ways.append([chr(arg[0][1])] if str(arg[0][0]) == "LITERAL" else ["0"])
        else:
            assert kind in ("AT", "ASSERT", "ASSERT_NOT"), kind
    return ["".join(x) for x in itertools.product(*ways)]


def test_every_alternative_contains_a_keyword():
    for rule in license_rules.rules():
        for text in examples(_parser.parse(rule.pattern.pattern)):
            assert any(k in text for k in rule.keywords), (rule.name, text)


@pytest.mark.parametrize("text, label", [("the expat license", "mit"), ("creative commons zero", "cc0"), ("license: x11", "mit"), ("license: python-2.0", "psf"), ("gnu library general public license", "lgpl"), ("license: 0bsd", "bsd")])
def test_names_that_had_no_keyword(text, label):
    assert label in {r.label for _, _, r in licenses.Scanner().detections(text)}
