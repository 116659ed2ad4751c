"""The labels of the languages beside English, in their given order."""

from __future__ import annotations

ARABIC = {
    "recipe_name": "اسم الوصفة",
    "cuisine_type": "نوع المطبخ",
    "meal_type": "نوع الوجبة",
    "dish_type": "نوع الطبق",
    "description": "الوصف",
    "prep_notes": "ملاحظات التحضير",
    "servings": "معلومات التقديم",
    "servings_unit": "حصص",
    "calories": "السعرات الحرارية",
    "protein": "البروتين",
    "carbs": "الكربوهيدرات",
    "fat": "الدهون",
    "fiber": "الألياف",
    "sugar": "السكر",
    "sodium": "الصوديوم",
    "nutrition_score": "درجة التغذية",
    "protein_calorie_ratio": "نسبة البروتين إلى السعرات",
    "protein_density": "كثافة البروتين",
    "g_per_100_kcal": "جرام لكل 100 سعرة",
    "diet_labels": "ملصقات الحمية",
    "health_labels": "الملصقات الصحية",
    "dietary_attributes": "الخصائص الغذائية",
    "total_ingredients": "إجمالي المكونات",
    "price": "السعر",
    "rating": "التقييم",
    "source": "المصدر",
    "prep_time": "وقت التحضير",
    "popularity": "الشعبية",
    "minutes": "دقائق",
    "nutrition_facts": "حقائق التغذية (لكل حصة)",
    "dietary_profile": "الملف الغذائي والصحي",
    "ingredients": "المكونات",
    "metadata": "بيانات الوصفة",
    "vegan": "نباتي صرف",
    "vegetarian": "نباتي",
    "gluten_free": "خال من الغلوتين",
    "dairy_free": "خال من منتجات الألبان",
    "keto": "مناسب للكيتو",
    "halal": "حلال",
    "low_calorie": "منخفض السعرات",
    "high_protein": "عالي البروتين",
    "low_carb": "منخفض الكربوهيدرات",
    "low_fat": "منخفض الدهون",
    "low_sodium": "منخفض الصوديوم",
    "high_fiber": "غني بالألياف",
}

FRENCH = {
    "recipe_name": "Nom de la Recette",
    "cuisine_type": "Type de Cuisine",
    "meal_type": "Type de Repas",
    "dish_type": "Type de Plat",
    "description": "Description",
    "prep_notes": "Notes de Préparation",
    "servings": "Informations de Service",
    "servings_unit": "portions",
    "calories": "Calories",
    "protein": "Protéines",
    "carbs": "Glucides",
    "fat": "Lipides",
    "fiber": "Fibres",
    "sugar": "Sucre",
    "sodium": "Sodium",
    "nutrition_score": "Score Nutritionnel",
    "protein_calorie_ratio": "Ratio Protéine/Calorie",
    "protein_density": "Densité de Protéines",
    "g_per_100_kcal": "g pour 100 kcal",
    "diet_labels": "Étiquettes de Régime",
    "health_labels": "Étiquettes de Santé",
    "dietary_attributes": "Attributs Diététiques",
    "total_ingredients": "Total des Ingrédients",
    "price": "Prix",
    "rating": "Évaluation",
    "source": "Source",
    "prep_time": "Temps de Préparation",
    "popularity": "Popularité",
    "minutes": "minutes",
    "nutrition_facts": "Valeur Nutritionnelle (par portion)",
    "dietary_profile": "Profil Diététique et de Santé",
    "ingredients": "Ingrédients",
    "metadata": "Métadonnées de la Recette",
    "vegan": "Végétalien",
    "vegetarian": "Végétarien",
    "gluten_free": "Sans Gluten",
    "dairy_free": "Sans Produits Laitiers",
    "keto": "Cétogène",
    "halal": "Halal",
    "low_calorie": "Faible en Calories",
    "high_protein": "Riche en Protéines",
    "low_carb": "Faible en Glucides",
    "low_fat": "Faible en Gras",
    "low_sodium": "Faible en Sodium",
    "high_fiber": "Riche en Fibres",
}
