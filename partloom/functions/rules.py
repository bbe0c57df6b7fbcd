"""Fixed rule tables of the catalog. The order of rules counts: the first that fits wins."""

# Categories of parts by patterns in their names.
PART_CATEGORIES = [
    ("Bearings", [r"bearing", r"^W\d+"]),
    ("Bushings", [r"bushing"]),
    ("Brush Holders & Parts", [r"brush holder", r"brush plate", r"brush connector"]),
    ("Starter & DC Motor Brush Springs", [r"brush spring"]),
    ("Brushes", [r"brush"]),
    ("Field Coils", [r"field coil", r"field housing", r"field frame", r"rotor coil"]),
    ("Gaskets, Grommets & Seals", [r"\bseal\b", r"gasket", r"grommet", r"o-ring", r"sealant"]),
    ("Test Equipment", [r"test lead"]),
    ("Stators", [r"stator"]),
    ("Pulleys", [r"pulley"]),
    ("Kits", [r"repair kit", r"collar kit", r"terminal kit", r"brake kit"]),
    ("Housings", [r"housing", r"frame", r"\bcover\b", r"baffle"]),
    ("Regulators & Rectifiers", [r"regulator", r"rectifier", r"diode", r"capacitor", r"slip ring", r"\bresistor\b", r"transformer"]),
    ("Relays, Solenoids & Switches", [r"solenoid", r"\brelay\b", r"ims switch"]),
    ("Shafts & Armatures", [r"armature", r"rotor", r"commutator", r"\bshaft\b"]),
    ("Drives & Gears", [r"\bdrive\b", r"\bgear\b", r"planetary", r"\bclutch\b", r"pinion"]),
    ("Hardware & Misc", [
        r"\bbolt\b", r"\bnut\b", r"\bscrew\b", r"washer", r"terminal", r"connector", r"insulator", r"\bboot\b", r"bracket", r"wiring",
        r"harness", r"\bplug\b", r"retainer", r"rivet", r"spacer", r"\bspring\b", r"\bstud\b", r"\bshim\b", r"\bpin\b", r"\bstrap\b",
        r"\blead\b", r"drain", r"\bfan\b", r"\bmisc\b", r"\bplate\b", r"sleeve", r"\bcollar\b", r"clamp", r"link-belt", r"alignment",
        r"expansion", r"magnet", r"thermal", r"\blever\b", r"amperage", r"center support", r"thrust",
    ]),
]

# The short classifier of product sheets; what fits none is Uncategorized.
SHEET_CATEGORIES = [
    ("Hardware", [r"\b(thru[\s-]?bolt|bolt|nut|screw|washer|pin|clip|stud|fastener|hardware)\b"]),
    ("Bearings", [r"\b(bearing|bushing|seal|sleeve)\b"]),
    ("Brushes", [r"\b(brush)\b"]),
    ("Electrical", [r"\b(rectifier|diode|regulator|capacitor|resistor|bridge)\b"]),
    ("Pulleys", [r"\b(pulley|belt)\b"]),
]

# makers' names that are spelled otherwise.
OEM_RENAMES = {
    "Leece Neville": "Leece-Neville",
    "Paris Rhone": "Paris-Rhone",
    "Mercedes Benz": "Mercedes-Benz",
    "Harley Davidson": "Harley-Davidson",
    "Poong Sung": "Poongsung",
    "Nippondenso": "Nippon Denso",
}

# Vehicle makes and the spelling that stays.
MAKE_RENAMES = {
    "GMC": "Gmc", "BMW": "Bmw", "KHD": "Khd", "OMC": "Omc", "UD": "Ud", "MG": "Mg", "BPM": "Bpm", "Man": "MAN", "McCulloch": "Mcculloch",
    "Case Ih": "Case/Ih", "Mercedes Benz": "Mercedes-Benz", "Harley Davidson": "Harley-Davidson", "Lister-Petter": "Lister Petter",
    "TCM Equipment": "Tcm Equipment", "Bluebird": "Blue Bird", "Ingersoll-Rand": "Ingersoll Rand", "Mitsubishi-Fuso": "Mitsubishi Fuso",
    "Agco Allis": "Agco-Allis", "MWM Diesel": "Mwm-Diesel", "Mwm Diesel": "Mwm-Diesel", "EZ-Go": "Ez-Go", "Red-D-Arc": "Red D Arc",
    "BMS Motorsports": "Bms Motorsports", "Bms Motor Sports": "Bms Motorsports", "Weidmann)": "Farymann (Farny & Weidmann)",
    "Division)": "White (Rio Division)", "Puch Ag)": "Steyr (Steyr-Daimler-Puch Ag)", "Holland)": "New Holland (Sperry New Holland)",
    "Group)": "Same (Deutz- Fahr Group)", "Teledyne -": "Teledyne",
}

# Makers whose units with long plain numbers are generators.
GENERATOR_MAKERS = ("MAHLE", "Prestolite", "General Electric", "Hitachi", "Letrika", "United Technologies", "Polaris", "Yamaha", "Unknown")

# Makers whose parts of one number are another's (base, variant).
MAKER_VARIANTS = [("Mitsubishi", "Mitsubishi Electric"), ("Hitachi", "Hitachi Automotive")]

# makers' names that keep their capitals.
MAKER_ACRONYMS = [
    "WAI", "PIC", "OEM", "GM", "BMW", "MES", "EGI", "API", "TSA", "MGU", "BEPCO", "BBB", "ACDelco", "NAPA", "OE", "AC", "DC", "LRI", "SAE",
    "IMS", "JD", "GMC", "DRI", "SEG", "CAE",
]

# Names of attributes that leak into application texts; the value is on the next line.
ATTRIBUTE_NAMES = [
    "manufacture", "oe_manufacturer", "family", "voltage", "mounting_type", "series", "amperage_rating", "fan_type", "regulator_type",
    "rotation_direction", "ground_type", "ground_polarity", "mounting_ear_quantity", "plug_type", "plug_clock_rear_view",
    "plug_clock_rear_view_main_mounting_ear_at", "pulley_belt_type", "pulley_groove_quantity", "pulley_class", "pulley_outside_diameter",
    "outside_diameter", "decoupled", "decoupled_or_clutch_pulley", "stator_type", "stator_leads", "circuit_type", "generator_rotation",
    "starter_rotation", "design", "power_rating", "kw", "tooth_quantity", "case_grounding", "nose_cone_type", "over-crank_protection",
    "solenoid_attached", "re-clockable_flange", "spline_quantity", "starter_drive_housing_position", "mounting_bolt_hole_quantity",
    "mounting_hardware_included", "mounting_shims_included",
]

# What part numbers of three catalogs look like: within a line, and for the third as a whole word.
NUMBER_PATTERNS = {
    "jn": r"(?<![A-Z0-9])(\d{3}-[0-9A-Z]{4,8}\*?)(?![A-Z0-9])",
    "metro": r"(?<![A-Z0-9])(\d{2}-(?=[0-9A-Z-]*\d)[0-9A-Z]{3,}(?:-[0-9A-Z]+)*\*?)(?![A-Z0-9])",
    "transpo": r"^(?=.*[A-Z])(?=.*\d)([A-Z0-9-]{3,20})$",
}
