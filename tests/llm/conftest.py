import os
from pathlib import Path

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def net():
    """A language network trained on a handful of sentences."""
    import numpy as np

    from foliary.llm.language import LANGUAGES, ByteNet, windows

    texts = {
        "en": "the pump must be tested before the first flight and the valve is replaced after each landing by the crew of the operator",
        "fr": "la pompe doit être contrôlée avant le premier vol et la vanne est remplacée après chaque atterrissage par le personnel de l'exploitant",
        "de": "die Pumpe muss vor dem ersten Flug geprüft werden und das Ventil wird nach jeder Landung von der Besatzung des Betreibers ersetzt",
        "es": "la bomba debe probarse antes del primer vuelo y la válvula se sustituye después de cada aterrizaje por la tripulación del operador",
        "it": "la pompa deve essere provata prima del primo volo e la valvola viene sostituita dopo ogni atterraggio dall'equipaggio del gestore",
    }
    r = np.random.default_rng(0)
    x, y = [], []
    for lang, t in texts.items():
        ws = t.split()
        for _ in range(150):
            a = int(r.integers(0, len(ws) - 8))
            x.append(windows(" ".join(ws[a : a + int(r.integers(6, 20))]))[0])
            y.append(LANGUAGES.index(lang))
    return ByteNet.fresh().fit(np.stack(x), np.array(y), rounds=6)
