from netledger.llm.names import link_names


def test_large_organisations_and_generic_names_are_linked(spark):
    """One organisation holds most spellings; a true trade word stands beside many names."""
    own = [f"Tonkefo{a}Pindo{b}{c}" for a in (" ", ", ", "  ", "-", " - ") for b in (" ", ", ", "  ", " - ") for c in ("Fibre", "FIBRE", "Fbr", "Fiber")]
    syllables = ["ba", "ke", "mi", "lo", "du", "ga", "ze"]
    others = [f"{a}{b}{c}rut Lindaro" for a in syllables for b in syllables for c in ("nax", "vosk")]
    others = [f"{n} {('Ltd', 'Limited')[k % 2]}" for n in others for k in range(2)]
    alone = ["Internet Exchange Ltd", "INTERNET EXCHANGE LTD", "Internet Exchange Limited"]
    names = own + others + alone + ["", "—"]
    org = {r.name: r.org for r in link_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len(org) == len(names)
    assert len({org[n] for n in own}) == 1 and len({org[n] for n in alone}) == 1
    assert org[""] != org["—"] and not {org[n] for n in own} & {org[n] for n in alone + others}
