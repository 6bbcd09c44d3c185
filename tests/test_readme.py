"""The README's counts of what is registered."""

import re
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("module, what", [("advantage", "advantage estimators"), ("losses", "policy losses")])
def test_readme_counts(module, what):
    registered = re.findall(r"^@register\(", (ROOT / f"rillflow/operators/{module}.py").read_text(), re.M)
    assert f" {len(registered)} {what}" in (ROOT / "README.md").read_text()
