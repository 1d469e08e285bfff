"""Fixed values of the speech normaliser: symbols, units, compounds, terms, words."""

NUMBER_WORDS = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten", "11": "eleven", "12": "twelve"}
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Γ": "capital gamma", "Δ": "delta", "Θ": "theta", "Λ": "lambda", "Ξ": "xi", "Π": "pi", "Σ": "sigma", "Φ": "phi", "Ψ": "psi", "Ω": "omega",
}
MATH = {
    "<=": "is less than or equal to", ">=": "is greater than or equal to", "!=": "is not equal to", "≤": "is less than or equal to", "≥": "is greater than or equal to", "≠": "is not equal to",
    "≈": "is approximately", "∝": "is proportional to", "∴": "therefore", "∞": "infinity", "√": "square root of", "∑": "the sum of", "Σ": "the sum of", "∫": "the integral of", "∂": "partial",
    "±": "plus or minus", "→": "gives", "⇌": "is in equilibrium with", "↔": "reversible to", "×": "times", "÷": "divided by", "·": "dot", "°": "degrees", "%": "percent", "=": "equals",
}
FRACTIONS = {"½": "half", "⅓": "one third", "¼": "one quarter", "¾": "three quarters", "⅔": "two thirds"}
COMMANDS = {
    "rightarrow": "gives", "to": "gives", "leftrightarrow": "is in equilibrium with", "rightleftharpoons": "is in equilibrium with", "times": "times", "div": "divided by", "pm": "plus or minus",
    "alpha": "alpha", "beta": "beta", "gamma": "gamma", "delta": "delta", "theta": "theta", "lambda": "lambda", "mu": "mu", "pi": "pi", "sigma": "sigma", "omega": "omega", "phi": "phi",
}
SUPERSCRIPTS = {"²": "squared", "³": "cubed", "⁴": "to the power four", "⁻": "to the power minus", "¹": "to the power one"}
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
UNITS = {
    "m/s2": "metres per second squared", "m/s^2": "metres per second squared", "m/s": "metres per second", "km/h": "kilometres per hour", "kg": "kilograms", "cm": "centimetres", "mm": "millimetres", "km": "kilometres",
    "nm": "nanometres", "mol": "moles", "Hz": "hertz", "Pa": "pascals", "N": "newtons", "J": "joules", "W": "watts", "V": "volts", "A": "amperes", "K": "kelvin", "C": "coulombs", "g": "grams", "m": "metres", "s": "seconds",
}
COMPOUNDS = {
    "H2O": "water", "CO2": "carbon dioxide", "O2": "oxygen", "N2": "nitrogen", "H2": "hydrogen", "NH3": "ammonia", "CH4": "methane", "NaCl": "sodium chloride", "HCl": "hydrochloric acid",
    "H2SO4": "sulphuric acid", "HNO3": "nitric acid", "NaOH": "sodium hydroxide", "CaCO3": "calcium carbonate", "C6H12O6": "glucose", "C2H5OH": "ethanol", "KMnO4": "potassium permanganate", "CO": "carbon monoxide",
}
STATES = {"(aq)": "aqueous", "(s)": "solid", "(l)": "liquid", "(g)": "gaseous"}
MECHANISMS = {"SN1": "S N one", "SN2": "S N two", "E1": "E one", "E2": "E two"}
ELEMENTS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr",
    "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn",
    "Fr", "Ra", "Ac", "Th", "U", "Np", "Pu", "W", "Re", "Os", "Ir", "Ta", "Hf",
)
BIOLOGY = {
    "70S": "seventy S", "80S": "eighty S", "50S": "fifty S", "30S": "thirty S", "60S": "sixty S", "40S": "forty S", "5'": "five prime", "3'": "three prime",
    "mRNA": "messenger R N A", "tRNA": "transfer R N A", "rRNA": "ribosomal R N A", "NADPH": "N A D P H", "NADP": "N A D P", "ATP": "A T P", "ADP": "A D P", "DNA": "D N A", "RNA": "R N A", "F1": "F one", "F2": "F two",
}
PAUSE_STOPS = (
    "the", "a", "an", "of", "in", "on", "at", "for", "to", "and", "or", "but", "is", "are", "was", "were", "be", "with", "by", "as",
    "this", "that", "these", "those", "your", "our", "its", "their", "his", "her", "no", "not",
)
EMPHASIS = {
    "physics": ("NEET", "formula", "important", "remember", "units"),
    "biology": ("NEET", "remember", "exception", "important", "NOT"),
    "chemistry": ("NEET", "mechanism", "remember", "important", "trend"),
}
