"""Published values the results must equal."""

# Spring traits of 27 individuals as published
# (sex, accuracy db, effectiveness E).
TRAITS = [
    ("ZZm", 1.515326187, 0.460738012),
    ("ZZm", 0.85178089, 0.696875128),
    ("ZWf", 0.43002621, 0.815439395),
    ("ZZm", 0.314493437, 0.888080627),
    ("ZZm", 0.754779783, 0.731395095),
    ("ZZm", 0.933409493, 0.667825803),
    ("ZZm", 0.861810618, 0.69330583),
    ("ZZm", 0.596188297, 0.787833346),
    ("ZZm", 0.711115438, 0.746934008),
    ("ZZm", 0.943735138, 0.664151196),
    ("ZZm", 0.956081676, 0.659757411),
    ("ZZm", 1.172550232, 0.582722337),
    ("ZWf", 0.309013414, 0.867376217),
    ("ZZm", 2.088624997, 0.256717083),
    ("ZZm", 0.875459235, 0.688448671),
    ("ZZm", 1.322232998, 0.529454449),
    ("ZWf", 1.717756828, 0.26276531),
    ("ZZm", 0.868004054, 0.69110176),
    ("ZZm", 0.177529363, 0.936822291),
    ("ZZm", 0.327317901, 0.883516761),
    ("ZZm", 0.199145594, 0.929129682),
    ("ZZm", 0.085682557, 0.969507987),
    ("ZZm", 0.0, 1.0),
    ("ZZm", 1.145894696, 0.592208293),
    ("ZZm", 0.691593391, 0.753881356),
    ("ZZm", 0.622373243, 0.77851486),
    ("ZZm", 0.578385181, 0.794168975),
]
SPRING_DE = {"ZWf": 2.33, "ZZm": 2.81}

# Encounter histories
# (history, male, female, Topt/100, Pmax/100, E, db/100, activity).
HISTORIES = [
    ("11", 1, 0, 0.31, 0.011, 0.461, 0.015, 0.039),
    ("11", 1, 0, 0.408, 0.016, 0.697, 0.009, 0.065),
    ("11", 0, 1, 0.35, 0.012, 0.815, 0.004, 0.031),
    ("11", 1, 0, 0.412, 0.017, 0.888, 0.003, 0.046),
    ("10", 1, 0, 0.35, 0.012, 0.731, 0.008, 0.034),
    ("11", 1, 0, 0.408, 0.016, 0.668, 0.009, 0.056),
    ("11", 1, 0, 0.361, 0.014, 0.693, 0.009, 0.038),
    ("10", 1, 0, 0.37, 0.013, 0.788, 0.006, 0.045),
    ("10", 1, 0, 0.379, 0.013, 0.747, 0.007, 0.039),
    ("10", 1, 0, 0.36, 0.012, 0.664, 0.009, 0.029),
    ("10", 1, 0, 0.421, 0.01, 0.66, 0.01, 0.03),
    ("10", 1, 0, 0.36, 0.015, 0.583, 0.012, 0.045),
    ("11", 0, 1, 0.419, 0.012, 0.867, 0.003, 0.045),
    ("11", 1, 0, 0.342, 0.014, 0.257, 0.021, 0.041),
    ("10", 1, 0, 0.408, 0.013, 0.688, 0.009, 0.028),
    ("10", 1, 0, 0.406, 0.011, 0.529, 0.013, 0.016),
    ("10", 0, 1, 0.342, 0.009, 0.263, 0.017, 0.098),
    ("10", 1, 0, 0.34, 0.009, 0.691, 0.009, 0.032),
    ("10", 1, 0, 0.371, 0.011, 0.937, 0.002, 0.043),
    ("10", 1, 0, 0.397, 0.013, 0.884, 0.003, 0.028),
    ("10", 1, 0, 0.358, 0.011, 0.929, 0.002, 0.054),
    ("10", 1, 0, 0.36, 0.014, 0.97, 0.001, 0.061),
    ("10", 1, 0, 0.35, 0.011, 0.99, 0.0, 0.172),
    ("10", 1, 0, 0.36, 0.012, 0.592, 0.011, 0.014),
    ("10", 1, 0, 0.35, 0.013, 0.754, 0.007, 0.038),
    ("10", 1, 0, 0.34, 0.011, 0.779, 0.006, 0.026),
    ("10", 1, 0, 0.37, 0.015, 0.794, 0.006, 0.035),
]

# Published model table of the performance curves
# (model, residual df, residual deviance, AIC, ΔAIC, % explained).
CURVE_MODELS = [
    ("j", 2756.35, 262.57, 1688.84, 0.0, 70.57),
    ("h", 2760.13, 264.88, 1707.66, 18.82, 70.31),
    ("f", 2760.12, 264.93, 1707.87, 19.03, 70.3),
    ("e", 2967.9, 299.67, 1724.75, 35.91, 66.41),
    ("d", 2766.84, 270.68, 1760.11, 71.27, 69.66),
    ("b", 2766.56, 270.73, 1760.93, 72.09, 69.65),
    ("i", 2989.09, 315.19, 1840.57, 151.73, 64.67),
    ("g", 2992.13, 317.28, 1854.36, 165.52, 64.43),
    ("c", 2986.68, 319.93, 1888.45, 199.61, 64.14),
    ("a", 3033.96, 358.89, 2152.09, 463.25, 59.77),
]

# Points of the published survival curves
# (covariate, survival, SE, lower, upper).
CURVE_ON_E = [
    (0.257, 0.578415907, 0.033243595, 0.512265529, 0.641866806),
    (0.60884, 0.682242184, 0.074256285, 0.523167578, 0.80774964),
    (0.99, 0.785056142, 0.106527248, 0.514504116, 0.926404289),
]
CURVE_ON_PMAX = {
    "Male": [
        (0.009, 0.994387912, 0.010499863, 0.815999041, 0.999858764),
        (0.01284, 0.841610574, 0.094249478, 0.570641745, 0.955043067),
        (0.017, 0.106316754, 0.123004448, 0.009318939, 0.600724993),
    ],
    "Female": [
        (0.009, 0.717804528, 0.32700798, 0.097039482, 0.983661467),
        (0.01692, 0.001833901, 0.005031105, 8.40733e-06, 0.286478224),
    ],
}
