import random


def words(n, seed, letters="abcdefgh"):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(n)]
