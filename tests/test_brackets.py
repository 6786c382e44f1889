"""Where brackets of scripts close."""

import random

import pytest

from millrace.operators import scripts as S


def test_brackets_close_as_a_walk_from_each_says():
    r = random.Random(3)
    for _ in range(300):
        text = [r.choice("()[]{}x") for _ in range(r.randrange(30))]
        reader = S.Reader([S.Token(t, 0) for t in text])
        for i, t in enumerate(text):
            if t in S._CLOSES:
                open_, past = [], None
                for j in range(i, len(text)):
                    if text[j] in S._CLOSES:
                        open_.append(S._CLOSES[text[j]])
                    elif text[j] in ")]}":
                        if open_.pop() != text[j]:
                            break
                        if not open_:
                            past = j + 1
                            break
                if past is None:
                    with pytest.raises(S.Doubt):
                        reader.past(i)
                else:
                    assert reader.past(i) == past
