"""sparkloom: a DataFrame-first engine for evidence mining and survey analysis."""
