import random
import string

import pytest

from brightwell.llm import secrets

RNG = random.Random(5)
ALNUM = string.ascii_letters + string.digits
pick = lambda chars, k: "".join(RNG.choice(chars) for _ in range(k))

def spans(text):
    return {text[s:e] for (s, e, _, x) in secrets.judged([text], secrets.fitted())[0] if x >= 0.5}


@pytest.mark.parametrize("text, key", [
    ("and AWS_KEY_ID={} here", "AKIA" + pick(string.ascii_uppercase + "234567", 16)), ("and GITHUB_PAT={} here", "ghp_" + pick(ALNUM, 36)),
    ("and x/y:{}/z here", "ghp_" + pick(ALNUM, 36)), ("see {} here", "AKIA" + "ABCDEFGHIJKLMNOP"),
])
def test_known_prefixes_anywhere(text, key):
    assert key in spans(text.format(key))


def test_value_after_a_name():
    value = pick("0123456789abcdef", 40)
    assert (14, 54) in [(s, e) for s, e, _ in secrets.candidates(f"see CLIENT_ID={value} here")]
