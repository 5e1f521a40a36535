import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairsmith.functions import jsonkit as jk


#: Texts without quotes, brackets and the like, which the kernel would take for structure of its own.
plain_text = st.text(alphabet=st.characters(categories=["L", "N"], include_characters=" .;:?!-"), max_size=12)
words = st.lists(plain_text, min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(words, st.sampled_from(["", "Voici la liste : ", "Sure thing.\n\n"]), st.sampled_from(["", " Bonne lecture.", "\n-- end"]))
def test_an_array_is_found_among_other_text(items, before, after):
    text = json.dumps(items)
    assert jk.extract(before + text + after) == text
    assert jk.extract(f"{before}```json\n{text}\n```{after}") == text == jk.extract(f"```{text}```")


@settings(max_examples=150, deadline=None)
@given(words, st.data())
def test_an_array_that_was_cut_off_keeps_its_whole_elements(items, data):
    keep = data.draw(st.integers(1, len(items)))
    cut = "[" + ", ".join(json.dumps(x) for x in items[:keep]) + data.draw(st.sampled_from(["", ",", ", ", " ,\n"]))
    assert json.loads(jk.extract(cut)) == items[:keep]


@settings(max_examples=150, deadline=None)
@given(st.lists(plain_text.filter(bool), min_size=1, max_size=5, unique=True), st.integers(1, 4))
def test_an_object_that_was_cut_off_is_closed_as_often_as_it_is_open(names, depth):
    text = json.dumps({n: k for k, n in enumerate(names)})[:-1]
    nested = "".join(json.dumps(f"level {k}").join(["{", ": "]) for k in range(depth)) + text
    value = json.loads(jk.extract(nested, "object"))
    for k in range(depth):
        value = value[f"level {k}"]
    assert value == {n: k for k, n in enumerate(names)} and jk.unmatched(nested, "{", "}") == depth + 1


@settings(max_examples=200, deadline=None)
@given(words, st.data())
def test_repair_undoes_wrong_commas(items, data):
    text = "["
    for k, x in enumerate(items):
        text += json.dumps(x)
        text += data.draw(st.sampled_from([",", " , ", ",,", " ", "\n", ", ,"] if k + 1 < len(items) else ["", ",", " ,\n", ",,"]))
    assert json.loads(jk.repair(text + "]")) == items


@settings(max_examples=100, deadline=None)
@given(words, st.sampled_from(["\n", "\r", "\r\n"]))
def test_repair_escapes_raw_line_ends(items, end):
    raw = "[" + ",".join(f'"{x}{end}{x}"' for x in items) + "]"
    assert json.loads(jk.repair(raw)) == [f"{x}\n{x}" for x in items]


def test_repair_of_objects():
    assert json.loads(jk.repair('{"a": {"b": 1} "c": "x" "d": {"e": 2,}}')) == {"a": {"b": 1}, "c": "x", "d": {"e": 2}}
    assert json.loads(jk.repair('{"a": {"b": 1} "c": [1] "d": {"e": 2,}}')) == [1]
    assert json.loads(jk.repair('{"a": {"b": 1} "c": [1] "d": {"e": 2,}}', "object")) == {"a": {"b": 1}, "c": [1], "d": {"e": 2}}
    assert json.loads(jk.repair('[{"a": 1}{"b": 2}]')) == [{"a": 1}, {"b": 2}]


def test_sanitize():
    assert jk.sanitize("{\"mood\": 'calm \"blue\"', \"n\": 7}") == '{"mood": "calm \\"blue\\"", "n": 7}'
    assert jk.sanitize('["a\\"\nb"]\n') == '["a\\"\\nb"]\n'


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("[]{}"), max_size=8), st.text(alphabet='[]{}"\\ x', max_size=8))
def test_only_structure_counts_as_open(brackets, inside):
    """Brackets in strings are none, however they are escaped."""
    string = json.dumps(inside)
    text = string.join(brackets) if brackets else string
    for pair in ("[]", "{}"):
        assert jk.unmatched(text, *pair) == max(0, brackets.count(pair[0]) - brackets.count(pair[1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.booleans() | st.integers() | plain_text | st.lists(st.integers(), max_size=2), max_size=6), st.sampled_from(["", " ", "\n\t"]))
def test_length_of_arrays_only(value, space):
    text = json.dumps(value)
    assert jk.array_length(space + text + space) == len(value)
    assert jk.array_length(text[:-1]) is None and jk.array_length(text + " and so on") is None and jk.array_length(json.dumps({"list": value})) is None
    assert jk.array_length(text[:-1] + (",]" if value else "NaN]")) is None and jk.array_length(text.replace("[", "['x', ", 1)) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | plain_text | st.sampled_from(["", " ", "\t x"]), max_size=6), st.integers(0, 4))
def test_string_arrays(items, least):
    kept = [x.strip() for x in items if x and x.strip()]
    assert jk.string_array(json.dumps(items), least) == (kept if len(kept) >= least else None)
    assert jk.plain_array(json.dumps(items)) == [x or "" for x in items]
    assert jk.string_array(json.dumps([*items, 5])) is None and jk.plain_array(json.dumps([*items, 5])) is None


scored = st.dictionaries(plain_text.filter(bool), st.tuples(st.integers(0, 9), plain_text), max_size=4)


@settings(max_examples=150, deadline=None)
@given(scored)
def test_judge_replies(scores):
    text = json.dumps({k: {"score": n, "reasoning": r} for k, (n, r) in scores.items()})
    assert jk.parse_judge(text, "object") == (1, scores) == jk.parse_judge(f"My view:\n```json\n{text}\n```", "object")
    assert jk.parse_judge(text.replace("}, ", "} "), "object")[1] == scores
    if scores:
        assert jk.parse_judge(text.replace('"score"', '"Score"')[:-1], "object")[1] == scores


@pytest.mark.parametrize("entry", ["2.5", "2.0", '"2"', "false", "[2]"])
def test_a_score_is_an_integer(entry):
    assert jk.parse_judge('{"tone": {"score": %s, "reasoning": "well"}}' % entry, "object") is None


@pytest.mark.parametrize(("reply", "scores"), [("null", {}), ('{"tone": null}', {"tone": (0, "")}), ('{"tone": {"reasoning": null}}', {"tone": (0, "")})])
def test_what_is_missing_is_zero(reply, scores):
    assert jk.parse_judge(reply)[1] == scores


@pytest.mark.parametrize("reply", ["", "I would rather not judge", '{"tone": {"sco', '{"tone": {"score": 1, "reasoning": "as [he] says"}}'])
def test_judge_replies_that_cannot_be_read(reply):
    assert jk.parse_judge(reply) is None


def test_judge_may_prefer_objects():
    assert jk.parse_judge('{"tone": {"score": 1, "reasoning": "as [he] says"}}', "object") == (1, {"tone": (1, "as [he] says")})
    assert jk.parse_judge('{"tone": {"score": 3} "pace": {"score": 1}}')[0] == 2


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet=st.characters(exclude_characters="'`", exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4, alphabet="abc"), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(values, min_size=1))
def test_valid_json_stays_as_it_is(value):
    text = json.dumps(value)
    assert jk.repair(text) == text and jk.repair(jk.repair(text)) == text
