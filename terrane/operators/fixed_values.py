"""Values that results depend on, stated as they are."""

# Predefined categories, with the values of each column of which any one is enough.
CATEGORIES: dict[str, dict[str, list[str]]] = {
    "arbres": {"class": ["Pinopsida"], "order": ["Fagales"], "genus": ["Crataegus", "Prunus", "Malus", "Sorbus", "Pyrus"]},
    "arbres_reduit": {"class": ["Pinopsida"], "order": ["Fagales"]},
    "plantes": {"kingdom": ["Plantae"]},
    "mammifères": {"class": ["Mammalia"]},
    "poissons": {
        "class": ["Actinopterygii", "Myxini", "Leptocardii", "Holocephali", "Dipneusti", "Petromyzonti", "Elasmobranchii"],
        "order": ["Perciformes", "Tetraodontiformes", "Clupeiformes", "Characiformes", "Syngnathiformes", "Beloniformes", "Gymnotiformes"],
    },
    "oiseaux": {"class": ["Aves"]},
    "reptiles": {"class": ["Chelonii", "Squamata", "Crocodylia"]},
    "arthropodes": {"class": ["Insecta", "Arachnida", "Malacostraca", "Branchiopoda", "Chilopoda", "Diplopoda"]},
    "pollinisateurs": {"order": ["Hymenoptera", "Lepidoptera", "Diptera"]},
    "graminees": {"family": ["Poaceae"]},
    "mousses": {"order": ["Sphagnales", "Hypnales", "Dicranales", "Bryales", "Buxbaumiales", "Diphysciales", "Grimmiales", "Andreaeales", "Polytrichales", "Hookeriales"]},
    "amphibiens": {"class": ["Amphibia"]},
    "mollusques": {"class": ["Gastropoda", "Bivalvia", "Cephalopoda", "Monoplacophora", "Scaphopoda"]},
    "araignées": {"order": ["Araneae"]},
    "champignons": {"kingdom": ["Fungi"]},
    "papillons": {"order": ["Lepidoptera"]},
}

# The categories of inventory tables, in their column names.
INVENTORY_CATEGORIES: dict[str, dict[str, list[str]]] = {
    "arbres": {"classe": ["Pinopsida"], "ordre": ["Fagales"], "genre": ["Crataegus", "Prunus", "Malus", "Sorbus", "Pyrus"]},
    "plantes": {"regne": ["Plantae"]},
    "mammifères": {"classe": ["Mammalia"]},
    "poissons": {"classe": ["Actinopterygii", "Myxini", "Leptocardii", "Holocephali", "Dipneusti", "Petromyzonti", "Elasmobranchii"]},
    "oiseaux": {"classe": ["Aves"]},
    "reptiles": {"ordre": ["Chelonii", "Squamata", "Crocodylia"]},
    "arthropodes": {"classe": ["Insecta", "Arachnida", "Malacostraca", "Branchiopoda", "Chilopoda", "Diplopoda"]},
    "graminees": {"famille": ["Poaceae"]},
    "mousses": {"ordre": ["Sphagnales", "Hypnales", "Dicranales", "Bryales", "Buxbaumiales", "Diphysciales", "Grimmiales", "Andreaeales", "Polytrichales", "Hookeriales"]},
    "amphibiens": {"classe": ["Amphibia"]},
    "mollusques": {"classe": ["Gastropoda", "Bivalvia", "Cephalopoda", "Monoplacophora", "Scaphopoda"]},
    "araignées": {"ordre": ["Araneae"]},
    "champignons": {"regne": ["Fungi"]},
    "papillons": {"ordre": ["Lepidoptera"]},
}

# Regions and their countries.
REGIONS: dict[str, list[str]] = {
    "Amerique_centrale": ["Panama", "Costa Rica", "Nicaragua", "El Salvador", "Honduras", "Guatemala", "Belize", "Colombia", "Mexico", "Cuba"],
    "Amerique_Sud": ["Colombia", "Brazil", "Argentina", "Peru", "Ecuador", "Chile", "Bolivia", "Paraguay", "Uruguay", "Venezuela"],
    "Asie_du_sud": ["India", "Sri Lanka", "Bangladesh", "Nepal", "Bhutan"],
    "Asie_de_est": ["Japan", "Republic of Korea"],
    "Asie_du_sud_est": ["Lao People's Democratic Republic", "Myanmar", "Thailand", "Malaysia", "Vietnam", "Cambodia", "Philippines"],
    "Europe": [
        "Spain", "Italy", "Slovenia", "Switzerland", "Croatia", "Portugal", "Austria", "France", "Germany", "Greece", "Slovakia", "Czechia", "Poland", "Lithuania",
        "Latvia", "Estonia", "Finland", "Hungary", "Romania", "Ukraine", "Bulgaria", "North Macedonia", "Bosnia and Herzegovina", "Serbia", "Kosovo", "Albania",
        "Moldova", "Turkey", "Belarus", "Montenegro", "Cyprus",
    ],
    "Med": ["Spain", "France", "Italy", "Slovenia", "Croatia", "Greece", "Turkey", "Tunisia", "Algeria", "Morocco"],
    "Maghreb": ["Tunisia", "Algeria", "Morocco"],
    "East_africa": ["Ethiopia", "Kenya", "Uganda", "Tanzania", "Rwanda", "Burundi", "South Sudan"],
}

# Taxonomy columns that are kept where present, in this order.
TAXONOMY_COLUMNS = [
    "speciesKey", "cdRef", "cdNom", "taxonID", "taxonKey",
    "species", "vernacularName_fr", "vernacularName_en", "genus", "family", "order", "class", "phylum", "kingdom",
    "nomScientifique", "nomVernaculaire", "genre", "famille", "ordre", "classe", "regne",
    "taxonRank", "especeProtegee", "statutBiogeoEspeceTaxref", "habitatEspeceTaxref", "occurrenceID",
]
