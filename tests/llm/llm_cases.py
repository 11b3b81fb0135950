"""Made-up prose for small tables."""

WORDS = "the of and river stone light under over green quiet window garden letter seven walking paper morning bridge story little".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randint(0, 99)) if rnd.random() < 0.2 else "") for _ in range(n))
