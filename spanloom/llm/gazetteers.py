"""Word lists of the gazetteer labeler; none of them is part of a candidate pattern."""

GIVEN = """
Aaron Adam Agnes Alan Albert Alejandro Alexander Alice Amanda Amélie Amy Ana Andrea Andreas Andrew Angela Anita Anna Anne Anthony Antonio Arthur
Barbara Beatriz Benjamin Bernd Brandon Brian Camille Carlos Carmen Carol Catherine Charles Charlotte Chloé Christian Christine Christopher Claire Claudia
Clara Daniel David Deborah Diego Dieter Donald Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Erika Eva Fernando François Frank Franz Frédéric Gabriel
George Gerhard Gisela Gloria Grace Hannah Hans Heather Heinz Helen Helga Henry Hugo Ingrid Isabel Jack Jacob Jacques James Jane Javier Jean Jennifer Jessica
Joan Johannes John Jorge José Joseph Joshua Juan Judith Julia Julie Jürgen Karen Karin Karl Katherine Kevin Klaus Laura Lauren Léa Linda Lisa Louis Louise Lucía
Luis Manuel Margaret Maria Marie Mark Markus Martin Mary Matthew Michael Michelle Miguel Monika Nancy Nathalie Nicolas Olivia Pablo Patricia Patrick Paul Pedro
Peter Petra Philip Philippe Pierre Rachel Raúl Rebecca Renate Richard Robert Roger Rosa Ruth Ryan Samuel Sandra Sara Sarah Scott Sharon Sofia Sophie Stefan Stephen
Steven Susan Susanne Sylvie Teresa Thomas Timothy Ursula Valérie Victor Vincent Virginia Walter Werner William Wolfgang Yves
""".split()

SURNAMES = """
Adams Allen Álvarez Anderson André Baker Bauer Becker Bernard Bertrand Brown Campbell Carter Clark Collins Davis Díaz Dubois Dupont Durand Edwards Evans Fernández
Fischer Fournier García Girard Gómez González Green Hall Harris Hernández Hill Hoffmann Huber Jackson Jiménez Johnson Jones King Klein Koch Krüger Lambert Laurent
Lee Lefebvre Leroy Lewis Lopez López Martin Martínez Mayer Meyer Miller Mitchell Moore Morales Moreau Moreno Morgan Morin Müller Muñoz Nelson Neumann Nguyen Parker
Perez Pérez Petit Phillips Ramírez Richter Rivera Roberts Robinson Rodríguez Romero Rossi Roux Ruiz Sánchez Schäfer Schmidt Schneider Schröder Schulz Scott Simon Smith
Stewart Taylor Thomas Thompson Torres Turner Vázquez Vincent Wagner Walker Weber White Williams Wilson Wolf Wright Young Zimmermann
""".split()

#: Ends of mail domains, leading digits of payment cards, calling codes, countries of the IBAN registry.
DOMAINS = "com org net edu gov de fr es uk io it nl ch at eu info".split()
ISSUERS = "34 37 4 51 52 53 54 55 60 62 65".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 971 972".split()
IBAN = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR".split()
AREAS = "202 206 212 213 214 215 240 301 303 305 310 312 323 404 408 412 415 416 424 469 503 510 512 514 602 604 612 613 617 619 646 650 702 703 713 718 720 773 800 808 816 818 832 866 877 888 917 919 949".split()
