import random

from quarry.llm import secret_scan

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"lower": LETTERS, "upper": LETTERS.upper(), "lower and digits": LETTERS + "0123456789", "base64": LETTERS + LETTERS.upper() + "0123456789+/"}


def test_recall_by_class_alone_and_behind_names():
    model, pick = secret_scan.trained(), random.Random(7)
    for alphabet in ALPHABETS.values():
        for before in ("", "AWS_ACCESS_KEY_FOR_SERVICE_ACCOUNT=", "srv/application/config/service/account/default/value/"):
            found = 0
            for _ in range(200):
                key = "".join(pick.choices(alphabet, k=24))
                spans = secret_scan.model_spans(before + key, [], model, 0.35)
                found += any(s < len(before) + 24 and len(before) < e for s, _, e in spans)
            assert found >= 190


def test_ordinary_text_is_left_alone():
    model = secret_scan.trained()
    words = ["getUserAccountOrderItemPrice", "Rechtsschutzversicherungsgesellschaften", "Donaudampfschifffahrtsgesellschaft", "internationalization_of_everything", "src/main/java/org/example/service/OrderService", "a-very-long-hyphenated-phrase-of-words", "=" * 60, "_" * 40]
    assert [w for w in words if secret_scan.model_spans(w, [], model, 0.35)] == []


def test_stretches_against_brute_force():
    pick = random.Random(3)
    for _ in range(200):
        ratios = [pick.uniform(-2, 2) for _ in range(pick.randrange(0, 40))]
        found = secret_scan.stretches(ratios, 0.1, 5)
        every = [(sum(r - 0.1 for r in ratios[a:b]), a, b) for a in range(len(ratios)) for b in range(a + 5, len(ratios) + 1)]
        best = max(every, default=(0, 0, 0))
        whole = len(ratios) >= 5 and sum(ratios) > 0.1 * len(ratios)
        assert found == [(0, len(ratios))] if whole else (best[1:] in found if best[0] > 1e-6 else found == [])
        assert all(e - s >= 5 for s, e in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
