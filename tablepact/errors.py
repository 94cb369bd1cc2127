"""Errors raised by the engine."""

from __future__ import annotations


class ContractError(ValueError):
    """A contract cannot be compiled, or does not fit the data it is applied to."""


class PortErrors(ContractError):
    """Several ports failed in one run; ``errors`` maps port name to its exception."""

    def __init__(self, errors: dict[str, Exception]):
        self.errors = dict(errors)
        detail = "; ".join(f"{name}: {err}" for name, err in self.errors.items())
        super().__init__(f"failed to run {len(self.errors)} port(s): {detail}")
