"""The published result tables, as far as the tests start from or end at them."""

# sector, rows, hours, cases, rate, rank by rate, rank by count
SECTORS = [
    ("Public Administration", 7877, 1919417696, 53883, 5.614515288911872, 1, 7),
    ("Transportation and Warehousing", 39658, 8800714349, 239852, 5.450739348840556, 2, 2),
    ("Arts, Entertainment, and Recreation", 3687, 992683053, 22768, 4.587164036132689, 3, 10),
    ("Retail Trade", 59108, 8562892171, 192744, 4.50184344613768, 4, 4),
    ("Accommodation and Food Services", 17464, 1815814372, 40393, 4.44902305245109, 5, 8),
    ("Health Care and Social Assistance", 44947, 15548005407, 333819, 4.294042756760407, 6, 1),
    ("Agriculture, Forestry, Fishing and Hunting", 4768, 762891331, 15811, 4.14502022962429, 7, 12),
    ("Wholesale Trade", 29831, 3459331311, 60235, 3.4824649381494295, 8, 6),
    ("Real Estate and Rental and Leasing", 11733, 612463259, 9973, 3.2566851491739848, 9, 15),
    ("Educational Services", 2904, 1554891157, 20855, 2.682502875665914, 10, 11),
    ("Administrative and Support and Waste Management and Remediation Services",
     28916, 2890045422, 37930, 2.6248722398107693, 11, 9),
    ("Manufacturing", 58329, 17521879652, 222689, 2.541839168203414, 12, 3),
    ("Other Services (except Public Administration)", 6967, 912069170, 11180, 2.4515684484763365, 13, 14),
    ("Utilities", 7005, 1148796605, 11688, 2.0348249549362136, 14, 13),
    ("Construction", 36475, 8273134408, 64756, 1.565452627903202, 15, 5),
    ("Professional, Scientific, and Technical Services", 4694, 1042184165, 6162, 1.1825165276810745, 16, 16),
    ("Information", 2442, 677730205, 3686, 1.0877484795000394, 17, 17),
    ("Mining, Quarrying, and Oil and Gas Extraction", 829, 313841679, 1080, 0.6882451071771127, 18, 19),
    ("Finance and Insurance", 833, 299112551, 843, 0.563667420294911, 19, 20),
    ("Management of Companies and Enterprises", 1529, 709355832, 1758, 0.49566097033230566, 20, 18),
]

# The rest in the order of SECTORS.
TARGET_HOURS = [
    1034445, 18013644, 1520014, 41847071, 4075362, 69909041, 2187869, 10785765, 670514, 3997290,
    4137876, 63701907, 1332615, 4914229, 21097996, 623577, 812934, 590014, 235742, 2873036,
]
RANK_OF_MEAN = [5, 1, 2, 9, 10, 3, 8, 11, 4, 7, 14, 12, 6, 16, 15, 13, 17, 18, 19, 20]
LARGEST_ROW_PERCENT = [
    1.02, 0.53, 10.79, 0.31, 0.68, 2.93, 0.62, 0.44, 3.85, 4.26,
    1.34, 0.37, 1.64, 0.97, 0.25, 2.30, 2.71, 5.85, 14.26, 3.11,
]
DEATHS = [33, 134, 9, 39, 23, 38, 20, 41, 12, 4, 34, 134, 15, 19, 180, 3, 3, 3, 0, 1]
DEATH_RANKS = [4, 7, 12, 14, 8, 18, 1, 9, 3, 17, 10, 13, 6, 5, 2, 16, 15, 11, 20, 19]

# Rate by band, smallest band first.
BAND_RATES = [
    (3.79, 5.52, 5.69, 5.67), (6.69, 5.24, 5.50, 5.48), (3.78, 6.04, 6.00, 4.30),
    (4.47, 4.26, 4.23, 4.90), (3.56, 4.04, 4.86, 4.59), (4.60, 5.32, 5.02, 4.03),
    (4.25, 4.13, 4.35, 4.02), (3.80, 3.34, 3.95, 3.28), (5.14, 4.00, 2.90, 2.25),
    (5.74, 5.21, 4.76, 2.28), (2.89, 3.53, 3.06, 1.91), (3.65, 3.40, 2.92, 2.14),
    (5.57, 3.29, 2.91, 1.35), (2.95, 2.63, 2.30, 1.50), (3.11, 2.82, 2.21, 0.77),
    (4.13, 2.31, 1.35, 0.80), (2.73, 3.07, 1.39, 0.67), (2.23, 1.43, 0.88, 0.49),
    (1.22, 0.70, 0.92, 0.51), (1.32, 0.80, 0.43, 0.47),
]

# ownership, rows, hours, cases, rate, percent of hours
OWNERSHIP = [
    ("1 private", 342786, 69934511673, 1207565, 3.4534165496038236, 89.87),
    ("2 state government", 15789, 4882258373, 66929, 2.741722985007619, 6.27),
    ("3 local government", 10992, 2815811704, 74527, 5.293464750794999, 3.62),
    ("4 unknown / not coded", 429, 184672045, 3084, 3.339974926903528, 0.24),
]

# band, rows, hours, cases
BANDS = [
    ("Under 20", 99492, 1486378156, 30964),
    ("20-99", 173400, 14106587529, 277306),
    ("100-249", 62586, 16128635646, 307143),
    ("250+", 34518, 46095652464, 736692),
]

# regions by rate: name, rows, rank over all, rate to six places; the first ten of enough rows
# and those too small among them
REGIONS = [
    ("AE", 1, 1, 12.840268), ("ME", 1843, 2, 6.242311), ("PW", 2, 3, 5.582033), ("MH", 1, 4, 5.464318),
    ("MT", 1194, 5, 5.204122), ("VT", 731, 6, 5.137616), ("WA", 8550, 7, 4.875038), ("ID", 2318, 8, 4.583617),
    ("OR", 6157, 9, 4.537867), ("CT", 4797, 10, 4.483253), ("SD", 1355, 11, 4.408346),
    ("NV", 3546, 12, 4.395047), ("NH", 1860, 13, 4.282800), ("HI", 1955, 14, 4.265847),
]

# rows dropped per rule, then kept
WATERFALL = [6, 0, 9046, 221, 15, 0, 146, 3853, 369996]

CLEAN_ROWS, CLEAN_HOURS, CLEAN_CASES, CLEAN_RATE = 369996, 77817253795, 1352105, 3.475077657101482
RAW_ROWS = 383283
TARGET_RATE = 6.242310606957536
RHO, RHO_P = 0.7157894736842104, 0.000386913
SLOPE, SLOPE_LOW, SLOPE_HIGH = -0.17515691989477292, -0.19757616121854188, -0.15273767857100395
SLOPE_P, PER_DOUBLING = 6.52e-53, -0.12140952518062603
MEAN_OF_RATES = 4.2758651443951
