import random
import string

import pytest

from lexgrove.llm import secrets
from lexgrove.llm.common import vocabulary

SCANNER = secrets.Scanner(vocabulary("byte_bpe_50k.tiktoken"))
LETTERS = string.ascii_letters + string.digits


def drawn(seed, n, letters=LETTERS):
    r = random.Random(seed)
    return "".join(r.choices(letters, k=n))


def share(before, after, n=24, trials=200):
    """How many random strings are found whole between two texts."""
    found = 0
    for i in range(trials):
        x = drawn(i, n)
        spans = SCANNER.spans(before + x + after)
        found += any(s["start"] <= len(before) and s["end"] >= len(before) + n for s in spans)
    return found / trials


@pytest.mark.parametrize("before,after", [('{"mail":"a@b.c","key":"', '"}'), ("https://x.org/a?sig=", ""), ("https://x.org/a?b=1&sig=", "&c=2"), ("a@b.c,", ",x"), ("['www.x.org';", "]"), ("https://user:", "@x.org/a")])
@pytest.mark.parametrize("n", [20, 24, 32, 40])
def test_an_address_before_hides_nothing(before, after, n):
    assert share(before, after, n) > 0.97


@pytest.mark.parametrize("before,after", [("https://x.org/", ""), ("see www.x.org/a/", "/b"), ("git@x.org:a/", ".git"), ("https://", ".x.org/")])
def test_hosts_and_paths_are_left_out(before, after):
    assert share(before, after) == 0


@pytest.mark.parametrize("before,after", [("authorization=", ""), ("connection_string_for_production=", ""), ("config/production/service-account/", ""), ("config/production/", "/service-account/documents")])
@pytest.mark.parametrize("n", [20, 24, 32, 40])
def test_words_before_a_secret_hide_nothing(before, after, n):
    assert share(before, after, n) > 0.95


@pytest.mark.parametrize("alphabet", [LETTERS + "-_", LETTERS + "+/"])
def test_secrets_with_separators_after_words(alphabet):
    found = 0
    for i in range(200):
        x = "q" + drawn(i, 30, alphabet) + "Z"
        text = "connection_string_for_production=" + x
        found += any(s["kind"] == "random" for s in SCANNER.spans(text))
    assert found > 190


@pytest.mark.parametrize("text", ["connection_string_for_production/internationalization_of_documents/service-account/550e8400-e29b-41d4-a716-446655440000", "internationalization_of_documents/production", "the/well_known-names/of_all-things", "connection_string_for_production/internationalization_of_documents/service-account/" + "D41D8CD98F00B204E9800998ECF8427E", "documents_of_2024-01-02_production"])
def test_parts_of_words_and_known_kinds_are_left_out(text):
    assert SCANNER.spans(text) == []
