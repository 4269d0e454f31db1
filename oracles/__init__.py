"""Independent SQL texts for checking the registered queries."""


def all_oracles() -> dict[str, str]:
    from oracles import business, operators, raw

    return {**business.ORACLES, **operators.O, **raw.R}
