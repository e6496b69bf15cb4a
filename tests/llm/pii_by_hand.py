"""Texts written by hand, with what is personal in them: nothing here was seen in training."""

CASES = [
    ("We spoke to Katherine O'Brien and Wei Zhang about the results.", [("name", "Katherine O'Brien"), ("name", "Wei Zhang")]),
    ("Dr. John Smith referred the patient to Maria Gonzalez.", [("name", "John Smith"), ("name", "Maria Gonzalez")]),
    ("Please call Michael Johnson, phone 212-867-5309, before noon.", [("name", "Michael Johnson"), ("phone", "212-867-5309")]),
    ("Email john.smith@gmail.com for a copy of the protocol.", [("email", "john.smith@gmail.com")]),
    ("SSN 123-45-6789, 1600 Pennsylvania Avenue, Washington.", [("id_number", "123-45-6789"), ("address", "1600 Pennsylvania Avenue")]),
    ("Next of kin: Harold Whitcombe (07911 123456).", [("name", "Harold Whitcombe"), ("phone", "07911 123456")]),
    ("Patient: Beatriz Fontanelle, NHS number 485 777 3456.", [("name", "Beatriz Fontanelle"), ("id_number", "485 777 3456")]),
    ("The letter went to 42 Willow Lane and was returned.", [("address", "42 Willow Lane")]),
    ("Frau Heidi Brandmeier wohnt Lindenstraße 14.", [("name", "Heidi Brandmeier"), ("address", "Lindenstraße 14")]),
    ("Reply to s.okonkwo@st-marys.ac.uk by Friday.", [("email", "s.okonkwo@st-marys.ac.uk")]),
    ("Signed, Theodora Pappas", [("name", "Theodora Pappas")]),
    ("Attending physician Miguel Arroyo, phone +34 612 345 678.", [("name", "Miguel Arroyo"), ("phone", "+34 612 345 678")]),
    ("MRN: 7734512 was assigned to Prof. Lindqvist.", [("id_number", "7734512"), ("name", "Lindqvist")]),
    ("Her new address is 8 rue Voltaire, Lyon.", [("address", "8 rue Voltaire")]),
    ("Reviewed with Mr. Abernathy and Samira Haddad.", [("name", "Abernathy"), ("name", "Samira Haddad")]),
    ("Passport no. X4821937 belongs to Pavel Dvorak.", [("id_number", "X4821937"), ("name", "Pavel Dvorak")]),
    ("Hodgkin lymphoma and Crohn disease were excluded; the Glasgow coma score was 15.", []),
    ("Kaplan-Meier analysis of 345 patients gave p = 0.032 (NCT01234567).", []),
    ("The dose was raised from 20 mg to 40 mg on day 14 of 28.", []),
    ("See doi:10.1000/xyz.2020.1182 and catalogue number 4471/22.", []),
    ("Binding to EGFR and BRCA1 was measured in HeLa cells at 37 °C.", []),
    ("Parkinson disease severity was rated by the Hoehn and Yahr scale.", []),
]
