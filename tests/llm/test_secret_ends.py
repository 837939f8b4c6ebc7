import random
import string

import pytest

from brightwell.llm import secrets

RNG = random.Random(5)
ALNUM = string.ascii_letters + string.digits
pick = lambda chars, k: "".join(RNG.choice(chars) for _ in range(k))
JWT = f"eyJ{pick(ALNUM, 40)}.{pick(ALNUM, 500)}.{pick(ALNUM, 43)}"
BODY = "\n".join(pick(ALNUM + "+/", 64) for _ in range(200))


def spans(text):
    return {text[s:e] for (s, e, _, x) in secrets.judged([text], secrets.fitted())[0] if x >= 0.5}


def test_long_named_value_is_taken_whole():
    assert spans(f"the old token: {JWT} was here") == {JWT}


@pytest.mark.parametrize("head", ["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"])
def test_blocks_to_their_end_line(head):
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{head}{BODY}\n-----END RSA PRIVATE KEY-----"
    assert spans(f"before\n{block}\nafter, all of it") == {block}


def test_redaction_of_overlapping_spans(spark):
    key = "ghp_" + pick(ALNUM, 36)
    text = f'auth = "https://h/{key}/{pick(ALNUM, 30)}" and the rest stays'
    out = secrets.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().text
    assert key not in out and out.endswith(' and the rest stays')
