import random

from wardline.llm import decontaminate as D


def test_a_part_of_the_stated_length_is_found_wherever_it_lies():
    r = random.Random(3)

    def words(n):
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))

    assert D.SHORTEST == 155
    for size in (161, 208, 330):
        item = words(80)[: size - 1] + "x"
        index = D.Index([(1, words(30)), (2, item)])
        for at in range(0, len(item) - D.SHORTEST + 1, 3):
            part = item[at : at + D.SHORTEST]
            for text in (part, f"{words(20)} {part} {words(20)}"):
                assert [m[0] for m in D.find(text, index)] == [2], (size, at)
