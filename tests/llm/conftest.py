import pytest

from usagemill.llm.tokens import DEFAULT_VOCABULARY, tokenizer


@pytest.fixture(scope="session")
def tok():
    from pathlib import Path

    if not Path(DEFAULT_VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    return tokenizer()
