import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta kappa lambda sigma omega".split()) + str(r.randrange(40)) for _ in range(n))
