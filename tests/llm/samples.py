"""Rows that every operator must bear."""

AWKWARD = [
    (0, "The first text, with some words in it that repeat. The first text."),
    (1, ""),
    (2, None),
    (3, "The first text, with some words in it that repeat. The first text."),
    (3, "The first text, with some words in it that repeat. The first text."),
    (None, "an id that is null"),
    (4, "   \n\t "),
    (5, "x" * 30000),
    (6, "Ünïcode 日本語。 \u2581 \x00 token = 'abcdef0123456789' " * 400),
    (7, "w " * 20000),
]
