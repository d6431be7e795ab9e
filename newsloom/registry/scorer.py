"""A stand-in model for the checks: class scores from letter counts of the whole text."""


def letter_scorer():
    def score(texts):
        return [(t.count("e"), 2 * t.count("a"), 2 * t.count("o")) for t in texts]

    return score
